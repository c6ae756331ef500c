"""Graph workloads on the trade graph of customers, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import graph
from benchloom.plans.registry import Registry
from benchloom.sources.tables import load, trade_edges
from benchloom.storage import cut

registry = Registry()
query = registry.query

_EDGES = """
    hops AS (
        SELECT o_custkey * 3 AS c, l_partkey * 3 + 1 AS p, l_suppkey * 3 + 2 AS s
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    edges AS MATERIALIZED (
        SELECT c AS src, p AS dst FROM hops UNION SELECT p, s FROM hops UNION SELECT s, c FROM hops)
"""
_TRIANGLES = f"""
    {_EDGES},
    e AS MATERIALIZED (
        SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE src <> dst),
    t AS MATERIALIZED (
        SELECT x.a, x.b, y.b AS c FROM e x JOIN e y ON x.b = y.a JOIN e z ON z.a = x.a AND z.b = y.b)
"""


def _edges(spark, d):
    return trade_edges(load(spark, d, "orders"), load(spark, d, "lineitem"))


def _stored_edges(spark, d):
    return cut(_edges(spark, d), "trade-edges")


@query(f"""
    WITH {_EDGES}
    SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree
    FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id
""")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"""
    WITH {_TRIANGLES}
    SELECT id, count(*) AS triangles
    FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id
""")
def vertex_triangles(spark, d):
    return graph.triangles(_edges(spark, d))


@query(f"WITH {_TRIANGLES} SELECT count(*) AS triangles FROM t")
def triangle_total(spark, d):
    return graph.triangle_total(_edges(spark, d))


ITERS = 5


def _pagerank_sql() -> str:
    steps = ["r0 AS (SELECT id, 1.0::DOUBLE AS rank FROM v)"]
    for n in range(1, ITERS + 1):
        steps.append(f"""r{n} AS MATERIALIZED (
            SELECT v.id, 0.15 + 0.85 * coalesce(m.s, 0) AS rank FROM v LEFT JOIN (
                SELECT dst, sum(rank / n) AS s
                FROM edges JOIN deg USING (src) JOIN r{n - 1} ON id = src GROUP BY dst) m ON m.dst = v.id)""")
    return f"""
        WITH {_EDGES}, deg AS (SELECT src, count(*) AS n FROM edges GROUP BY src),
        v AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), {", ".join(steps)}
        SELECT id, round(rank, 6) AS rank FROM r{ITERS}
    """


@query(_pagerank_sql())
def pagerank(spark, d):
    return graph.pagerank(_stored_edges(spark, d), ITERS).withColumn("rank", F.round("rank", 6))


def _draw(*parts: str) -> str:
    digest = f"md5(concat_ws(':', '42', {', '.join(parts)}))"
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT + 0.5::DOUBLE) / {2**52}::DOUBLE)"


def _degree_sql(turn: int) -> str:
    u1, u2 = (_draw(f"'{c}'", "id::VARCHAR", f"'{turn}'") for c in "ab")
    return f"floor(exp(4.0 + 1.3 * sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})))"


_DEGREES = ", ".join(f"CASE WHEN {_degree_sql(k)} < n THEN {_degree_sql(k)} END" for k in range(graph.DRAWS))


@query(f"""
    WITH v AS (SELECT c_custkey AS id FROM customer), n AS (SELECT count(*) AS n FROM customer),
    g AS (SELECT id, n, coalesce({_DEGREES}, floor({_draw("'c'", "id::VARCHAR")} * n))::BIGINT AS degree FROM v, n),
    k AS (SELECT id, n, unnest(range(1, degree + 1)) AS k FROM g WHERE degree > 0)
    SELECT id AS src, floor({_draw("'t'", "id::VARCHAR", "k::VARCHAR")} * n)::BIGINT AS dst FROM k
""")
def lognormal_edges(spark, d):
    """A random out-neighbourhood for every customer."""
    customers = load(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return graph.lognormal_edges(customers, customers.count())
