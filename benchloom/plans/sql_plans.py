"""SQL workload and ratio estimate."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import estimate, sqlwork
from benchloom.plans.registry import Registry
from benchloom.sources.tables import load, points

registry = Registry()
query = registry.query


@query("""
    SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders WHERE o_totalprice > 200000
""")
def sql_select(spark, d):
    return sqlwork.sql_select(load(spark, d, "orders"), 200_000)


_TOTALS = """
    count(*) AS n_items, sum(l_quantity) AS sum_qty,
    round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 10) AS avg_discount
"""


def _rounded(totals):
    return totals.withColumns({"revenue": F.round("revenue", 4), "avg_discount": F.round("avg_discount", 10)})


@query(f"SELECT l_returnflag, l_linestatus, {_TOTALS} FROM lineitem GROUP BY ALL")
def sql_aggregate_by_flags(spark, d):
    return _rounded(sqlwork.sql_aggregate(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@query(f"SELECT l_partkey, {_TOTALS} FROM lineitem GROUP BY ALL")
def sql_aggregate_by_part(spark, d):
    return _rounded(sqlwork.sql_aggregate(load(spark, d, "lineitem"), "l_partkey"))


@query("""
    SELECT o_orderkey, o_orderdate, l_linenumber, l_partkey, l_quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def sql_join(spark, d):
    return sqlwork.sql_join(load(spark, d, "orders"), load(spark, d, "lineitem")).select(
        "o_orderkey", "o_orderdate", "l_linenumber", "l_partkey", "l_quantity"
    )


@query("""
    SELECT o_orderpriority, count(*) AS n_items,
           round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderpriority
""")
def revenue_by_priority(spark, d):
    totals = sqlwork.revenue_by_priority(load(spark, d, "orders"), load(spark, d, "lineitem"))
    return totals.withColumn("revenue", F.round("revenue", 4))


@query("""
    WITH p AS (
        SELECT ((l_orderkey * 7919 + l_linenumber) % 10007) / 10007.0::DOUBLE AS x,
               ((l_partkey * 104729 + l_suppkey) % 10009) / 10009.0::DOUBLE AS y
        FROM lineitem),
    c AS (SELECT count(*) AS n, count(*) FILTER (x * x + y * y <= 1) AS n_inside FROM p)
    SELECT n, n_inside, round(4.0 * n_inside / n, 6) AS estimate,
           round(4.0 * sqrt((n_inside / n) * (1 - n_inside / n) / n), 6) AS std_error
    FROM c
""")
def ratio_estimate(spark, d):
    pi = estimate.ratio_estimate(points(load(spark, d, "lineitem")), estimate.in_unit_circle(), 4.0)
    return pi.withColumns({c: F.round(c, 6) for c in ("estimate", "std_error")})
