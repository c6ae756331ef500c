"""Graph workloads over an edge table (src, dst): degrees, triangles, PageRank, a random graph."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from benchloom.functions.columns import uniform
from benchloom.operators.skew import cache_parts, hot_keys, lookup_join, per_salt, sliced_join, with_salt
from benchloom.storage import Scratch, cut

# Random edges that are drawn from one array at a time.
BLOCK = 10_000

# Random edges that one task draws, in the mean.
EDGES_PER_TASK = 1_000_000

# Draws of a random degree that are tried.
DRAWS = 16

# Most targets of a vertex in one row.
BLOCK_TARGETS = 1024

# Targets that triangles send at a time: so many for each pair of neighbours, and so many in any case.
SENT_PER_PAIR, SENT_AT_ONCE = 2, 32_000_000


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once, smaller id first, without self-loops."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def degrees(edges: DataFrame) -> DataFrame:
    """Out-, in- and total degree of every vertex, repeated edges counted as often as they occur."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        edges.select(F.col("dst").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    return ends.groupBy("id").agg(
        F.sum("out").alias("out_degree"), F.sum("in").alias("in_degree"),
        F.count("*").alias("degree"),
    )


def _pointed(pairs: DataFrame, size: DataFrame, scratch: Scratch) -> DataFrame:
    """Each pair from its end of lower (degree, id) to the other. The pairs are shuffled for one end at a time."""
    sides = pairs
    for end, other in (("src", "dst"), ("dst", "src")):
        degree = size.select(F.col("id").alias(end), F.col("degree").alias("n"), F.col("degree").alias(f"{end}_degree"))
        sides = lookup_join(sides, degree, end, [other])
        if end == "src":
            sides = scratch.cut(sides, "one-end")
            scratch.drop("pairs")
    up = F.struct("src_degree", "src") < F.struct("dst_degree", "dst")
    return sides.select(
        F.when(up, F.col("src")).otherwise(F.col("dst")).alias("low"),
        F.when(up, F.col("dst")).otherwise(F.col("src")).alias("high"),
    )


def _buckets(reach: str) -> Column:
    """Buckets of a vertex with so many targets: a power of two, half a block of targets in each at most in the mean."""
    bits = F.greatest(F.lit(0), F.ceil(F.log2(2 * F.col(reach) / BLOCK_TARGETS)))
    return F.pow(F.lit(2), bits).cast("long")


def _bucket(target: Column, buckets: Column) -> Column:
    return F.pmod(F.xxhash64(target), buckets)


def adjacency_blocks(pointed: DataFrame, vertices: DataFrame) -> DataFrame:
    """Targets of every vertex in rows (low, bucket, chunk, targets) of at most `BLOCK_TARGETS`.

    A vertex has one or more buckets of targets, as `_buckets` says; a bucket that got more than a block is cut into chunks.
    """
    known = vertices.select(F.col("id").alias("low"), "buckets", F.col("reach").alias("n"))
    placed = lookup_join(pointed, known, "low", ["high"]).withColumn("bucket", _bucket(F.col("high"), F.col("buckets")))
    order = Window.partitionBy("low", "bucket").orderBy("high")
    chunk = F.floor((F.row_number().over(order) - 1) / BLOCK_TARGETS)
    return placed.withColumn("chunk", chunk).groupBy("low", "bucket", "chunk").agg(F.collect_list("high").alias("targets"))


def _split(targets: str, bucket: str, buckets: str, to_buckets: str) -> Column:
    """A block's targets by the buckets of a vertex with as many or more of them."""
    def part(i: Column) -> Column:
        at = F.col(bucket) + i * F.col(buckets)
        return F.struct(at.alias("bucket"), F.filter(targets, lambda t: _bucket(t, F.col(to_buckets)) == at).alias("sent"))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.col(to_buckets) / F.col(buckets)) - 1), part)


def triangles(edges: DataFrame) -> DataFrame:
    """Number of triangles at each vertex that has one, whatever the direction of the edges.

    Edges point from the lower to the higher (degree, id). A triangle is found once, as a common
    target of both ends of one of its edges. Targets lie in blocks of bounded size; of the two ends of an
    edge, that with fewer targets sends each of them to the one block of the other where it may be. So an edge sends
    the shorter list once, no row holds more than a block, and a vertex of very many targets or
    edges is spread over its blocks, and over slices of these. Receiving vertices take turns, so that no more than a few targets
    for each pair of neighbours are under way at a time, however dense the graph, and tables are removed after their last use.
    """
    with Scratch(edges.sparkSession, "triangles") as scratch:
        pairs = scratch.cut(undirected(scratch.cut(edges.select("src", "dst"), "edges")), "pairs")
        scratch.drop("edges")
        size = scratch.cut(degrees(pairs).select("id", "degree"), "degrees")
        pointed = scratch.cut(_pointed(pairs, size, scratch), "pointed")
        scratch.drop("one-end")
        reach = pointed.groupBy(F.col("low").alias("id")).agg(F.count("*").alias("reach"))
        # A vertex without targets has part in triangles as the last corner only.
        vertices = scratch.cut(size.join(reach, "id").withColumn("buckets", _buckets("reach")), "reaches")
        blocks = scratch.cut(adjacency_blocks(pointed, vertices), "blocks")
        both = pointed
        for end, other in (("low", "high"), ("high", "low")):
            known = vertices.select(F.col("id").alias(end), F.col("degree").alias("n"), F.col("reach").alias(f"{end}_reach"), F.col("buckets").alias(f"{end}_buckets"))
            both = scratch.cut(lookup_join(both, known, end, [other]), f"{end}-ends")
            scratch.drop("pointed" if end == "low" else "low-ends")
        up = F.col("low_reach") <= F.col("high_reach")
        pulls = scratch.cut(both.select(
            *[F.when(up, F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (
                ("low", "high", "from"), ("high", "low", "to"), ("low_buckets", "high_buckets", "from_buckets"), ("high_buckets", "low_buckets", "to_buckets"),
                ("low_reach", "high_reach", "n"))],
        ), "pulls")
        scratch.drop("high-ends")
        n_pairs, n_sent = size.agg(F.coalesce(F.sum("degree"), F.lit(0)) / 2).first()[0], pulls.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        hot = {c: hot_keys(scratch.cut(pulls.groupBy(c).agg(F.count("*").alias("n")), f"{c}-counts"), c) for c in ("from", "to")}
        rounds = max(1, math.ceil(n_sent / max(SENT_PER_PAIR * n_pairs, SENT_AT_ONCE)))
        parts = [scratch.cut(_corners(pulls.drop("n"), blocks, hot, k, rounds), "corners") for k in range(rounds)]
        if rounds == 1:
            return cut(parts[0], "triangles")
        scratch.drop("blocks", "pulls")
        return cut(reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("triangles").alias("triangles")), "triangles")


def _corners(pulls: DataFrame, blocks: DataFrame, hot: dict[str, DataFrame], turn: int, turns: int) -> DataFrame:
    """Triangles at each vertex, of those found at receiving vertices whose turn it is."""
    here = F.pmod(F.xxhash64("to", F.lit(turns)), F.lit(turns)) == turn if turns > 1 else F.lit(True)
    sent = sliced_join(pulls.where(here), blocks.select(F.col("low").alias("from"), "bucket", "targets"), "from", hot["from"], ["to"])
    sent = sent.select("from", "to", F.inline(_split("targets", "bucket", "from_buckets", "to_buckets"))).where(F.size("sent") > 0)
    held = blocks.select(F.col("low").alias("to"), "bucket", "targets").where(here)
    common = with_salt(sent, "to", hot["to"], ["from"], "_slice").join(
        per_salt(held, "to", hot["to"], "_slice"), ["to", "bucket", "_slice"],
    ).select("from", "to", F.array_intersect("sent", "targets").alias("apex"))
    found = F.size("apex").cast("long")
    corners = F.concat(
        F.array(F.struct(F.col("from").alias("id"), found.alias("n")),
                F.struct(F.col("to").alias("id"), found.alias("n"))),
        F.transform("apex", lambda a: F.struct(a.alias("id"), F.lit(1).cast("long").alias("n"))),
    )
    return (
        common.where(F.size("apex") > 0).select(F.inline(corners))
        .groupBy("id").agg(F.sum("n").alias("triangles"))
    )


def triangle_total(edges: DataFrame) -> DataFrame:
    """Number of triangles in the graph."""
    total = F.coalesce(F.sum("triangles"), F.lit(0)) / 3
    return triangles(edges).agg(total.cast("long").alias("triangles"))


def _links(edges: DataFrame, hot: DataFrame, parts: int) -> DataFrame:
    """Edges placed by source, those of a hot source in several places.

    Inside a place they are in order of target: every iteration sums by target, and runs of
    one target keep that in the processor cache.
    """
    links, key = edges.select("src", "dst"), ["src"]
    if not hot.isEmpty():
        links, key = with_salt(links, "src", hot, ["dst"], "slice"), ["src", "slice"]
    return links.repartition(parts, *key).sortWithinPartitions("dst")


# Most vertices of a partition that are built into a hash table.
VERTICES_PER_TABLE = 1_000_000


def link_parts(spark: SparkSession, n_links: int, n_sources: int) -> int:
    """Partitions of the links and their sources: they grow with either, whatever number the session has."""
    # Half of what a table may hold, as hashing deals vertices out unevenly.
    return max(cache_parts(spark, n_links), math.ceil(2 * n_sources / VERTICES_PER_TABLE))


def _join_by(sources: DataFrame) -> str:
    """How links meet their sources: a hash table of each partition, or sorted if some partition has too many."""
    largest = sources.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] or 0
    return "shuffle_hash" if largest <= VERTICES_PER_TABLE else "merge"


def _along(links: DataFrame, senders: DataFrame, hot: DataFrame, how: str = "shuffle_hash") -> DataFrame:
    """Each link with the columns of its source; under a hash table the links stay where they are and keep their order."""
    if "slice" in links.columns:
        return links.join(per_salt(senders, "src", hot, "slice").hint(how), ["src", "slice"])
    return links.join(senders.hint(how), "src")


def pagerank(edges: DataFrame, iters: int, reset: float = 0.15, cut_every: int = 5) -> DataFrame:
    """Rank of every vertex after a fixed number of iterations.

    Ranks start at 1 and become reset + (1 - reset) * sum(rank / out-degree) over in-edges;
    ranks are not normalized and the rank of vertices without out-edges is not spread.

    Links are placed once by source, hot sources in slices, and out-degrees by vertex; both stay
    cached. An iteration shuffles only ranks and messages, the latter summed per target before
    the shuffle. Vertices without out-edges send nothing and join in the last iteration only.
    `edges` is read twice, so pass a stored table, not a costly query.
    """
    if iters < 1:
        raise ValueError("pagerank needs at least one iteration")
    degree = cut(edges.groupBy("src").agg(F.count("*").alias("out_degree")), "out-degrees")
    n_links, n_sources = degree.agg(F.coalesce(F.sum("out_degree"), F.lit(0)), F.count("*")).first()
    parts = link_parts(edges.sparkSession, n_links, n_sources)
    hot = hot_keys(degree, "src", "out_degree")
    links = _links(edges, hot, parts).persist()
    sources = degree.repartition(parts, "src").persist()
    how = _join_by(sources)
    ranks = sources.withColumn("rank", F.lit(1.0))
    for step in range(1, iters + 1):
        senders = ranks.select("src", (F.col("rank") / F.col("out_degree")).alias("message"))
        sums = _along(links, senders, hot, how).groupBy(F.col("dst").alias("src")).agg(F.sum("message").alias("sum"))
        rank = reset + (1 - reset) * F.coalesce("sum", F.lit(0.0))
        ranks = sources.join(sums, "src", "left" if step < iters else "full").select(
            "src", "out_degree", rank.alias("rank")
        )
        if step % cut_every == 0 or step == iters:
            ranks = cut(ranks, "ranks")
    links.unpersist()
    sources.unpersist()
    return ranks.select(F.col("src").alias("id"), "rank")


def lognormal_edges(vertices: DataFrame, n: int, mu: float = 4.0, sigma: float = 1.3, seed: int = 42) -> DataFrame:
    """Random edges among vertices 0..n-1 with log-normal out-degrees below n and uniform targets.

    A degree of n or more is drawn again, up to `DRAWS` times; only if all of these were (n lies far below the bulk of
    the distribution) any degree below n is as likely as another. `vertices` has a column `id` with the sources to draw for. Draws depend on the ids and the
    seed only. Sources are dealt to tasks by the edges expected of them, as their own files may be few.
    """
    def drawn(turn: int) -> Column:
        u1, u2 = (uniform(seed, F.lit(c), F.col("id"), F.lit(turn)) for c in "ab")
        return F.floor(F.exp(mu + sigma * F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2)))

    # The first draw below n: the distribution is cut off there and does not pile up.
    kept = F.coalesce(*[F.when(drawn(k) < n, drawn(k)) for k in range(DRAWS)], F.floor(uniform(seed, F.lit("c"), F.col("id")) * n))
    degree = kept.cast("long")
    expected = vertices.count() * min(math.exp(mu + sigma * sigma / 2), float(n))
    parts = max(1, math.ceil(expected / EDGES_PER_TASK))
    # Explode in two steps, so that a vertex of very high degree is never one huge array.
    blocks = F.sequence(F.lit(1), F.col("degree"), F.lit(BLOCK))
    block = F.sequence(F.col("first"), F.least(F.col("first") + (BLOCK - 1), F.col("degree")))
    return (
        vertices.select("id").repartition(parts, "id").select("id", degree.alias("degree")).where("degree > 0")
        .select("id", "degree", F.explode(blocks).alias("first"))
        .select("id", F.explode(block).alias("k"))
        .select(F.col("id").alias("src"),
                F.floor(uniform(seed, F.lit("t"), F.col("id"), F.col("k")) * n).cast("long").alias("dst"))
    )
