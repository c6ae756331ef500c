"""Exact top-k search by inner product: tiles of queries and shards, partial selection, merge tree.

Queries and candidates are packed into blocks of rows. A tile is one query block with one shard. Tiles are grouped in a grid of
cells, some query blocks by some shards: a block goes to each cell of its row, a shard to each of its column, by a shuffle that no
driver sees, so a task holds a bounded number of matrices. A tile gives its k best per query by partial selection. Lists are merged in their
cell and then in a tree of fixed fan-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from benchloom.llm.frames import parts_for
from benchloom.storage import cut

QUERY_BLOCK = 1024
SHARD_ROWS = 8192
FAN_IN = 8
# Query blocks, and shards, of one cell.
CELL_BLOCKS, CELL_SHARDS = 8, 4

LISTS = "block long, place long, queries binary, ids binary, scores binary, counts binary"


def quantized(vector: str, scale: int = 64) -> Column:
    """floor(scale * x) of every component x as a double; NULL if the vector is not all finite numbers.

    The bounds of 64-bit integers make floor saturate, as Spark's floor of a double does.
    """
    good = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * scale)))


def _narrow(matrix: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they all fit."""
    low, high = (int(matrix.min()), int(matrix.max())) if matrix.size else (0, 0)
    return matrix.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max)).tobytes()


def _matrix(raw: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, f"i{len(raw) // (rows * dim)}" if raw else np.int64).astype(np.int64).reshape(rows, dim)


def _pack(rows: DataFrame, block: Column, name: str) -> DataFrame:
    """Rows (id, vector) packed into matrices of one dimension each; ids ascend in each block."""
    def packed(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        matrix = np.array(frame["vector"].tolist(), dtype=np.int64).reshape(len(frame), -1)
        return pd.DataFrame({name: [keys[0]], "dim": [keys[1]], "ids": [frame["id"].to_numpy(np.int64).tobytes()], "vectors": [_narrow(matrix)]})

    return (
        rows.select(block.alias(name), F.size("vector").alias("dim"), "id", "vector")
        .groupBy(name, "dim").applyInPandas(packed, f"{name} long, dim int, ids binary, vectors binary")
    )


def _products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Inner products as exact integers: in doubles where these hold every sum, else in 64-bit integers.

    Sums beyond 64 bits are an error, as in integer SQL.
    """
    if not queries.size or not shard.size:
        return np.zeros((len(queries), len(shard)), np.int64)
    bound = max(map(abs, (int(queries.min()), int(queries.max())))) * max(map(abs, (int(shard.min()), int(shard.max())))) * queries.shape[1]
    if bound < 2**53:
        return queries.astype(np.float64) @ shard.astype(np.float64).T
    if bound < 2**63:
        return queries @ shard.T
    exact = queries.astype(object) @ shard.astype(object).T
    if max(abs(x) for x in exact.ravel()) >= 2**63:
        raise OverflowError("an inner product does not fit 64 bits")
    return exact.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above, level = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
        room = k - len(above)
        if len(level) > room:
            level = level[np.argpartition(ids[level], room - 1)[:room]] if room else level[:0]
        chosen = np.concatenate((above, level))
        ids, scores = ids[chosen], scores[chosen]
    order = np.lexsort((ids, -scores))
    return ids[order], scores[order]


def _listed(block: int, place: int, queries: np.ndarray, best: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({
        "block": [block], "place": [place], "queries": [queries.tobytes()],
        "ids": [np.concatenate([b[0] for b in best]).astype(np.int64).tobytes()],
        "scores": [np.concatenate([b[1] for b in best]).astype(np.int64).tobytes()],
        "counts": [np.array([len(b[0]) for b in best], np.int32).tobytes()],
    })


def top_k(
    queries: DataFrame, candidates: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
    scale: int = 64, query_block: int = QUERY_BLOCK, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Each query's k highest inner products with other rows: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller id. Rows that share a query's id are its own and no candidates. Vectors
    that are NULL or hold NULL or a non-finite component, and rows without id, take no part;
    neither do candidates of another dimension than the query. Repeated candidates count as
    often as they stand there; a repeated query is one query, but a query id that stands twice with different
    vectors is two, which the result cannot tell apart. Empty vectors score 0. No queries or no candidates: no rows.
    """
    def rows(df: DataFrame) -> DataFrame:
        return df.select(F.col(vec_id).cast("long").alias("id"), quantized(vector, scale).alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")

    asked, searched = rows(queries).distinct(), rows(candidates)
    n_blocks, n_shards = parts_for(asked.count(), query_block), parts_for(searched.count(), shard_rows)
    # A hash of the id and a draw per row: rows that share an id do not share a block.
    asked_packed = _pack(asked, F.pmod(F.xxhash64("id", "vector"), F.lit(n_blocks)), "block")
    shards = _pack(searched, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_shards)), "shard")
    asked_packed, shards = cut(asked_packed, "query-blocks"), cut(shards, "vector-shards")
    n_rows, n_columns = parts_for(n_blocks, CELL_BLOCKS), parts_for(n_shards, CELL_SHARDS)
    cell = ["row", "column", "dim"]

    def in_cells(packed: DataFrame, own: Column, n: int) -> DataFrame:
        """Packed rows in every cell of their row or column of the grid; as many tasks as cells."""
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        at = (own, F.col("other")) if "block" in packed.columns else (F.col("other"), own)
        placed = packed.withColumn("other", other).withColumns(dict(zip(("row", "column"), at, strict=True))).drop("other")
        return placed.repartition(n_rows * n_columns, *cell)

    left = in_cells(asked_packed, F.pmod("block", F.lit(n_rows).cast("long")), n_columns)
    right = in_cells(shards, F.pmod("shard", F.lit(n_columns).cast("long")), n_rows)

    def tiles(keys: tuple, blocks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        """Of each query block of a cell: the best of all its tiles there."""
        out, dim = [], int(keys[2])
        for block in blocks.itertuples(index=False):
            q_ids = np.frombuffer(block.ids, np.int64)
            asked_rows, best = _matrix(block.vectors, len(q_ids), dim), [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
            for shard in held.itertuples(index=False):
                ids = np.frombuffer(shard.ids, np.int64)
                products = _products(asked_rows, _matrix(shard.vectors, len(ids), dim))
                for at, (query, scores) in enumerate(zip(q_ids, products, strict=True)):
                    own = ids == query
                    found = _best(ids[~own], scores[~own], k) if own.any() else _best(ids, scores, k)
                    best[at] = _best(*map(np.concatenate, zip(best[at], found, strict=True)), k)
            # Blocks of other dimensions share the block number; the dimension keeps them apart.
            out.append(_listed(block.block * (1 << 31) + dim, int(keys[1]), q_ids, best))
        return pd.concat(out) if out and len(held) else pd.DataFrame({c.split()[0]: [] for c in LISTS.split(", ")})

    def merge(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        asked_ids = np.frombuffer(frame["queries"].iloc[0], np.int64)
        lists: list[list] = [[] for _ in asked_ids]
        for row in frame.itertuples(index=False):
            ids, scores = np.frombuffer(row.ids, np.int64), np.frombuffer(row.scores, np.int64)
            ends = np.cumsum(np.frombuffer(row.counts, np.int32))
            for mine, lo, hi in zip(lists, np.concatenate(([0], ends[:-1])), ends, strict=True):
                mine.append((ids[lo:hi], scores[lo:hi]))
        best = [_best(np.concatenate([x[0] for x in m]), np.concatenate([x[1] for x in m]), k) for m in lists]
        return _listed(keys[0], keys[1], asked_ids, best)

    def unpacked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                counts = np.frombuffer(row.counts, np.int32)
                yield pd.DataFrame({
                    "query_id": np.repeat(np.frombuffer(row.queries, np.int64), counts),
                    "rank": np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1,
                    "vec_id": np.frombuffer(row.ids, np.int64), "score": np.frombuffer(row.scores, np.int64),
                })

    spark = queries.sparkSession
    lists = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(tiles, LISTS)
    width = n_columns
    while width > 1:
        lists = lists.withColumn("place", F.floor(F.col("place") / FAN_IN)).groupBy("block", "place").applyInPandas(merge, LISTS)
        width = parts_for(width, FAN_IN)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").union(
        lists.mapInPandas(unpacked, "query_id long, rank int, vec_id long, score long"))
