from __future__ import annotations

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from benchloom.operators import graph, skew
from conftest import plan_of


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def hub_graph(seed=1, n=60, m=150):
    """A vertex 0 that is an end of more than a third of all edges, both ways, beside random ones."""
    rng = random.Random(seed)
    pairs = [(0, v) for v in range(1, n)] + [(v, 0) for v in range(1, n, 2)]
    return pairs + [(rng.randrange(1, n), rng.randrange(1, n)) for _ in range(m)]


def brute_triangles(pairs):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    counts = {}
    for a in near:
        found = sum(1 for b, c in combinations(near[a], 2) if c in near[b])
        if found:
            counts[a] = found
    return counts


def brute_pagerank(pairs, iters, reset=0.15):
    out = {}
    for a, _ in pairs:
        out[a] = out.get(a, 0) + 1
    ranks = {v: 1.0 for pair in pairs for v in pair}
    for _ in range(iters):
        sums = dict.fromkeys(ranks, 0.0)
        for a, b in pairs:
            sums[b] += ranks[a] / out[a]
        ranks = {v: reset + (1 - reset) * s for v, s in sums.items()}
    return ranks


def test_degrees(spark):
    rows = {r.id: (r.out_degree, r.in_degree, r.degree) for r in
            graph.degrees(edges_of(spark, [(1, 2), (1, 2), (2, 3), (3, 3)])).collect()}
    assert rows == {1: (2, 0, 2), 2: (1, 2, 3), 3: (1, 2, 3)}


def test_one_triangle(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (3, 1), (4, 4)]
    assert {r.id: r.triangles for r in graph.triangles(edges_of(spark, pairs)).collect()} == {1: 1, 2: 1, 3: 1}
    assert graph.triangle_total(edges_of(spark, pairs)).first().triangles == 1
    assert graph.triangle_total(edges_of(spark, [(1, 2)])).first().triangles == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_triangles_with_a_hub_equal_brute_force(spark, lookup_size, no_auto_broadcast, seed):
    pairs = hub_graph(seed)
    got = {r.id: r.triangles for r in graph.triangles(edges_of(spark, pairs)).collect()}
    assert got == brute_triangles(pairs)
    flipped = {r.id: r.triangles for r in graph.triangles(edges_of(spark, [(b, a) for a, b in pairs])).collect()}
    assert flipped == got


@pytest.mark.parametrize("block", [2, 5])
def test_triangles_in_small_blocks(spark, monkeypatch, no_auto_broadcast, lookup_size, block):
    """A clique beside a hub: vertices with many blocks meet others with few."""
    monkeypatch.setattr(graph, "BLOCK_TARGETS", block)
    pairs = hub_graph(3) + list(combinations(range(100, 130), 2)) + [(0, v) for v in range(100, 130)]
    got = {r.id: r.triangles for r in graph.triangles(edges_of(spark, pairs)).collect()}
    assert got == brute_triangles(pairs)


def test_no_block_is_larger_and_a_vertex_of_a_clique_is_spread(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_TARGETS", 8)
    pointed = spark.createDataFrame(list(combinations(range(200), 2)), "low long, high long")
    reach = pointed.groupBy(F.col("low").alias("id")).agg(F.count("*").alias("reach"))
    blocks = graph.adjacency_blocks(pointed, reach.withColumn("buckets", graph._buckets("reach"))).cache()
    assert blocks.agg(F.max(F.size("targets"))).first()[0] <= 8
    assert blocks.select("low", F.explode("targets").alias("high")).exceptAll(pointed).isEmpty()
    assert blocks.agg(F.sum(F.size("targets"))).first()[0] == pointed.count()
    # The vertex with most targets lies in all of the shuffle's partitions.
    first = blocks.where("low = 0").repartition(4, "low", "bucket").select(F.spark_partition_id().alias("p")).distinct()
    assert first.count() == 4
    blocks.unpersist()


def test_rank_of_a_two_cycle_stays_one(spark):
    ranks = graph.pagerank(edges_of(spark, [(1, 2), (2, 1)]), 3).collect()
    assert [round(r["rank"], 12) for r in ranks] == [1.0, 1.0]


@pytest.mark.parametrize("cut_every", [1, 5])
def test_pagerank_with_a_hub_equals_brute_force(spark, no_auto_broadcast, monkeypatch, cut_every):
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 50)
    pairs = hub_graph() + [(5, 1000), (5, 1000)]  # an end without out-edges, and a repeated edge
    edges = edges_of(spark, pairs)
    want = brute_pagerank(pairs, 4)
    for frame in (edges, edges.orderBy(F.desc("dst"))):
        got = {r.id: r["rank"] for r in graph.pagerank(frame, 4, cut_every=cut_every).collect()}
        assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_hot_source_is_cut_into_slices(spark):
    counts = spark.createDataFrame([(0, 900), (1, 50), (2, 50)], "id long, n long")
    hot = skew.hot_keys(counts, "id")
    assert [tuple(r) for r in hot.collect()] == [(0, 4)]  # four shuffle partitions in tests
    rows = spark.range(1000).selectExpr("if(id < 900, 0, 1 + id % 2) AS id", "id AS other")
    sizes = skew.with_salt(rows, "id", hot, ["other"], "slice").groupBy("id", "slice").count().collect()
    assert len([r for r in sizes if r.id == 0]) == 4 and max(r["count"] for r in sizes) < 300
    lookup = skew.per_salt(counts, "id", hot, "slice")
    assert lookup.groupBy("id").count().where("id = 0").first()["count"] == 4


def test_sliced_join_equals_plain_join(spark, no_auto_broadcast):
    rows = spark.range(2000).selectExpr("if(id % 3 = 0, 7, id % 50) AS k", "id AS other")
    lookup = spark.range(40).selectExpr("id AS k", "id * 10 AS v")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.sliced_join(rows, lookup, "k", skew.hot_keys(counts, "k"), ["other"])
    assert got.exceptAll(rows.join(lookup, "k")).isEmpty() and got.count() == rows.join(lookup, "k").count()


@pytest.mark.parametrize("hot_rows", [[], [(0, 4)]])
def test_cached_links_are_neither_shuffled_nor_sorted(spark, no_auto_broadcast, hot_rows):
    hot = spark.createDataFrame(hot_rows, "src long, splits int")
    links = graph._links(edges_of(spark, hub_graph()), hot, 3).persist()
    assert links.count() == len(hub_graph())
    senders = spark.range(60).selectExpr("id AS src", "rand(1) AS message")
    plan = plan_of(graph._along(links, senders, hot)).split("== Physical Plan ==")[1]
    join, cached = plan.index("ShuffledHashJoin"), plan.index("InMemoryTableScan")
    assert "Exchange" not in plan[join:cached] and "Sort [" not in plan[join:cached]
    links.unpersist()


def test_lognormal_degrees_and_targets(spark):
    n = 4000
    edges = graph.lognormal_edges(spark.range(n), n, mu=2.0, sigma=0.8, seed=3).persist()
    log = F.log(F.col("out") + 0.5)  # degrees are rounded down
    row = edges.groupBy("src").agg(F.count("*").alias("out")).agg(F.avg(log), F.stddev(log)).first()
    assert abs(row[0] - 2.0) < 0.08 and abs(row[1] - 0.8) < 0.08
    ends = edges.agg(F.min("dst"), F.max("dst"), F.avg("dst")).first()
    assert 0 <= ends[0] and ends[1] < n and abs(ends[2] / n - 0.5) < 0.02
    again = graph.lognormal_edges(spark.range(n).repartition(5), n, mu=2.0, sigma=0.8, seed=3)
    assert again.exceptAll(edges).isEmpty() and edges.count() == again.count()


def test_partitions_grow_with_vertices_and_links_beyond_the_session(spark, monkeypatch):
    assert graph.link_parts(spark, 1000, 10) == 1
    monkeypatch.setattr(skew, "ROWS_PER_TASK", 10)
    assert graph.link_parts(spark, 1000, 10) == skew.shuffle_parts(spark)
    assert graph.link_parts(spark, 10**9, 10) == 200
    assert graph.link_parts(spark, 10**6, 10**8) == 200


@pytest.mark.parametrize(("bound", "node"), [(5, "SortMergeJoin"), (10**6, "ShuffledHashJoin")])
def test_hash_tables_are_bounded(spark, no_auto_broadcast, monkeypatch, bound, node):
    monkeypatch.setattr(graph, "VERTICES_PER_TABLE", bound)
    sources = spark.range(60).selectExpr("id AS src").repartition(3, "src").persist()
    links = edges_of(spark, hub_graph()).repartition(3, "src").persist()
    how = graph._join_by(sources)
    assert node in plan_of(graph._along(links, sources.selectExpr("src", "1.0 AS message"), None, how))
    pairs = hub_graph(5)
    want = brute_pagerank(pairs, 3)
    got = {r.id: r["rank"] for r in graph.pagerank(edges_of(spark, pairs), 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v]) < 1e-9 for v in want)
    sources.unpersist()
    links.unpersist()


def test_lognormal_degrees_do_not_pile_up_below_n(spark):
    n = 1500
    out = graph.lognormal_edges(spark.range(n), n).groupBy("src").count().collect()
    high = sorted(r["count"] for r in out)
    assert high[-1] < n and sum(d == n - 1 for d in high) <= 1
    # Of 1,500 draws about eight lie beyond n; those just below must not have become more by them.
    assert sum(d > 0.95 * n for d in high) <= 4


def test_lognormal_degrees_far_below_the_bulk(spark):
    out = graph.lognormal_edges(spark.range(300), 3, mu=8.0, sigma=0.5).groupBy("src").count().collect()
    assert {r["count"] for r in out} == {1, 2} and 150 < len(out) < 250


def test_lognormal_degree_beyond_one_block(spark, monkeypatch):
    whole = graph.lognormal_edges(spark.range(50), 50, mu=4.0).persist()
    monkeypatch.setattr(graph, "BLOCK", 7)
    blocks = graph.lognormal_edges(spark.range(50), 50, mu=4.0)
    assert whole.exceptAll(blocks).isEmpty() and blocks.exceptAll(whole).isEmpty()
    assert 30 < whole.groupBy("src").count().agg(F.max("count")).first()[0] <= 49


def test_lognormal_edges_are_drawn_in_as_many_tasks_as_they_call_for(spark, monkeypatch):
    whole = graph.lognormal_edges(spark.range(200).coalesce(1), 200, mu=2.0, sigma=0.8, seed=3)
    monkeypatch.setattr(graph, "EDGES_PER_TASK", 100, raising=False)
    dealt = graph.lognormal_edges(spark.range(200).coalesce(1), 200, mu=2.0, sigma=0.8, seed=3)
    assert whole.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() > 10
    assert dealt.exceptAll(whole).isEmpty() and whole.exceptAll(dealt).isEmpty()


def test_triangles_in_turns_equal_brute_force_and_leave_one_table(spark, monkeypatch, lookup_size, no_auto_broadcast):
    monkeypatch.setattr(graph, "SENT_PER_PAIR", 0)
    monkeypatch.setattr(graph, "SENT_AT_ONCE", 100)
    turns, plain, stored, cut = [], graph._corners, [], graph.cut
    monkeypatch.setattr(graph, "_corners", lambda *args: turns.append(args[-2:]) or plain(*args))
    monkeypatch.setattr(graph, "cut", lambda df, name: stored.append(name) or cut(df, name))
    pairs = hub_graph(4) + list(combinations(range(100, 120), 2)) + [(None, 3), (3, None)]
    got = {r.id: r.triangles for r in graph.triangles(edges_of(spark, pairs)).collect()}
    assert got == brute_triangles([p for p in pairs if None not in p])
    assert len(turns) > 5 and [k for k, _ in turns] == list(range(turns[0][1])) and stored == ["triangles"]
