"""Best items for asked users under a factor model, exact, without scoring all pairs.

Items lie in blocks of falling length of their factors. By Cauchy-Schwarz no item scores more for a user than the product of
both lengths, so a user whose k-th best score is above that bound for the next block needs no further one. Blocks
are read in rounds of one, two, four, ... blocks, up to `ROUND_BLOCKS`; a round broadcasts its blocks, whose size is fixed, to
the users that still need them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from benchloom.storage import Scratch, cut

BLOCK_ITEMS = 4096
ROUND_BLOCKS = 32
# Users scored against a block at a time.
ROWS = 512


def _with_length(rows: DataFrame, key: str) -> DataFrame:
    """(key, factors, length) of the rows whose factors are all there and finite."""
    squares = F.aggregate(F.transform("factors", lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    factors = F.col("factors").cast("array<double>")
    kept = rows.select(key, factors.alias("factors")).where(f"{key} IS NOT NULL AND factors IS NOT NULL")
    kept = kept.withColumn("length", F.sqrt(squares))
    return kept.where(F.col("length").isNotNull() & (F.col("length") < float("inf")))


def top_items(users: DataFrame, items: DataFrame, k: int, rounds: list[int] | None = None) -> DataFrame:
    """The k items of highest product for each user: (user, place, item, score, n_blocks).

    `users` is (user, factors) of those asked for, `items` (item, factors), each key once and all factors of one length. Ties go
    to the smaller item; with fewer than k items a user gets them all. Rows with NULL keys or with NULL, missing or
    non-finite factors take no part. `n_blocks` is how many blocks of items the user was scored against; `rounds`
    collects how many users each round had.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    spark = users.sparkSession
    fields = "user long, factors array<double>, length double, items array<long>, scores array<double>, n_blocks int"
    with Scratch(spark, "top-items") as scratch:
        sized = _with_length(items, "item")
        blocks = max(1, math.ceil(sized.count() / BLOCK_ITEMS))
        placed = scratch.cut(sized.repartitionByRange(blocks, F.desc("length"), "item").withColumn("block", F.spark_partition_id()), "items")
        asked = _with_length(users, "user").select(
            F.col("user").cast("long").alias("user"), "factors", "length", F.array().cast("array<long>").alias("items"),
            F.array().cast("array<double>").alias("scores"), F.lit(0).alias("n_blocks"),
        )
        finished, first, width = [], 0, 1
        while True:
            here = placed.where(F.col("block").between(first, first + width - 1)).toArrow()
            after = placed.where(F.col("block") >= first + width).agg(F.max("length")).first()[0]
            sent = spark.sparkContext.broadcast(_blocks(here))

            def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, ROWS):
                        yield _search(batch.slice(at, ROWS), sent.value, k)

            state = scratch.cut(asked.mapInArrow(searched, fields), "state")
            sent.destroy()
            if rounds is not None:
                rounds.append(state.count())
            # Rounding must not end a search that a tie would change.
            done = F.lit(True) if after is None else (F.size("scores") == k) & (F.element_at("scores", -1) > F.col("length") * after * (1 + 1e-9))
            finished.append(state.where(done))
            asked = state.where(~done)
            first, width = first + width, min(2 * width, ROUND_BLOCKS)
            if after is None or asked.isEmpty():
                break
        out = finished[0]
        for more in finished[1:]:
            out = out.unionByName(more)
        pairs = out.select("user", "n_blocks", F.posexplode(F.arrays_zip("items", "scores")).alias("place", "pair"))
        return cut(pairs.select("user", (F.col("place") + 1).alias("place"), F.col("pair.items").alias("item"), F.col("pair.scores").alias("score"), "n_blocks"), "top-items")


def _blocks(items: pa.Table) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Ids, factors and greatest length of each block, in order."""
    out, block = [], items["block"].to_numpy()
    for at in np.unique(block):
        rows = items.filter(pa.array(block == at))
        factors = np.array(rows["factors"].combine_chunks().flatten()).reshape(rows.num_rows, -1)
        out.append((rows["item"].to_numpy().astype(np.int64), factors, float(rows["length"].to_numpy().max())))
    return out


def _search(users: pa.RecordBatch, blocks: list[tuple[np.ndarray, np.ndarray, float]], k: int) -> pa.RecordBatch:
    """The users with the best of what they had and of the blocks that may better it."""
    factors = np.array(users.column("factors").flatten()).reshape(users.num_rows, -1)
    length = users.column("length").to_numpy()
    items = [np.array(x, dtype=np.int64) for x in users.column("items").to_pylist()]
    scores = [np.array(x, dtype=np.float64) for x in users.column("scores").to_pylist()]
    worst = np.array([s[-1] if len(s) == k else -np.inf for s in scores])
    seen = users.column("n_blocks").to_numpy().copy()
    for ids, matrix, longest in blocks:
        active = np.flatnonzero(worst <= length * longest * (1 + 1e-9))
        if not len(active):
            break
        found = factors[active] @ matrix.T
        least = np.partition(found, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(active), -np.inf)
        for row, user in enumerate(active):
            near = np.flatnonzero(found[row] >= max(least[row], worst[user]))
            both, of = np.concatenate((scores[user], found[row][near])), np.concatenate((items[user], ids[near]))
            best = np.lexsort((of, -both))[:k]
            scores[user], items[user] = both[best], of[best]
            if len(best) == k:
                worst[user] = both[best[-1]]
        seen[active] += 1
    return pa.RecordBatch.from_arrays([
        users.column("user"), users.column("factors"), users.column("length"),
        pa.array(items, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64())), pa.array(seen, pa.int32()),
    ], names=["user", "factors", "length", "items", "scores", "n_blocks"])
