"""Joins of many rows to one row per key, for when one key may hold a large share of the rows.

A lookup that is small enough by count is broadcast. Beyond that, rows are shuffled by key,
and hot keys are cut into slices first. AQE's own skew join covers joins of two plain
shuffles only; a lookup that is itself an aggregate would keep a hot key in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DatetimeType, NumericType, StringType

# Most rows, and most bytes before any encoding, of a lookup table that is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20

# Rows that make a task worth starting, and most rows of a task that are kept in memory or built into a table.
ROWS_PER_TASK, MOST_ROWS_PER_TASK = 100_000, 5_000_000


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def cache_parts(spark: SparkSession, rows: int) -> int:
    """Partitions for rows that a loop reads again and again.

    The session's number, fewer for few rows, and more for so many rows that its number would make them too large.
    """
    return max(1, min(shuffle_parts(spark), math.ceil(rows / ROWS_PER_TASK)), math.ceil(rows / MOST_ROWS_PER_TASK))


def is_small(table: DataFrame) -> bool:
    """Whether a stored table may be broadcast, from its row count, which its files hold, and then its bytes.

    A number counts as eight bytes; the lengths of all else are added up.
    """
    rows = table.count()
    fixed = [f.name for f in table.schema if isinstance(f.dataType, (NumericType, BooleanType, DatetimeType))]
    if rows > BROADCAST_ROWS or 8 * rows * len(fixed) > BROADCAST_BYTES:
        return False
    others = [F.octet_length(c if isinstance(table.schema[c].dataType, (StringType, BinaryType)) else F.to_json(F.struct(c))) for c in table.columns if c not in fixed]
    if not others:
        return True
    longer = table.agg(F.sum(sum((F.coalesce(n, F.lit(0)).cast("long") for n in others), F.lit(0).cast("long")))).first()[0]
    return 8 * rows * len(fixed) + (longer or 0) <= BROADCAST_BYTES


def hot_keys(counts: DataFrame, key: str, n: str = "n", name: str | None = None) -> DataFrame:
    """Keys with more than one partition's even share of all rows, and into how many slices to cut them.

    `counts` is a stored table with each key once. With P shuffle partitions fewer than P keys
    can pass the test, whatever the data size, which is why they may go through the driver and
    be broadcast. Without any, the joins against them vanish from the plan.
    """
    spark = counts.sparkSession
    parts = shuffle_parts(spark)
    total = counts.agg(F.sum(n)).scalar()
    hot = counts.where(F.col(n) * parts > total).select(
        F.col(key).alias(name or key), F.ceil(F.col(n) * parts / total).cast("int").alias("splits")
    )
    return spark.createDataFrame(hot.toArrow())


def with_salt(rows: DataFrame, key: str, hot: DataFrame, spread: list[str], name: str) -> DataFrame:
    """Add column `name`: 0 for most rows, a slice number from the `spread` columns for hot keys."""
    slice_ = F.pmod(F.xxhash64(*spread), F.coalesce("splits", F.lit(1)))
    return rows.join(F.broadcast(hot), key, "left").withColumn(name, slice_.cast("int")).drop("splits")


def per_salt(lookup: DataFrame, key: str, hot: DataFrame, name: str) -> DataFrame:
    """Repeat a lookup row once per slice of its key. Only hot keys have more than one."""
    slices = F.sequence(F.lit(0), F.coalesce("splits", F.lit(1)) - 1)
    return lookup.join(F.broadcast(hot), key, "left").withColumn(name, F.explode(slices)).drop("splits")


def sliced_join(rows: DataFrame, lookup: DataFrame, key: str, hot: DataFrame, spread: list[str]) -> DataFrame:
    """Inner join by shuffle, hot keys cut into slices by the `spread` columns."""
    left = with_salt(rows, key, hot, spread, "_slice")
    right = per_salt(lookup, key, hot, "_slice")
    return left.join(right, [key, "_slice"]).drop("_slice")


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str, spread: list[str], n: str = "n") -> DataFrame:
    """Inner join of `rows` to a stored `lookup` of each key with its count of rows in column `n`."""
    if is_small(lookup):
        return rows.join(F.broadcast(lookup.drop(n)), key)
    return sliced_join(rows, lookup.drop(n), key, hot_keys(lookup, key, n), spread)


def keep_keys(rows: DataFrame, per_key: DataFrame, key: str, keep: Column, n: str = "n") -> DataFrame:
    """Rows whose key passes `keep`, a condition on `per_key`: a stored table of each key with its count.

    Beyond broadcast size, rows of hot keys are kept or left where they are by a broadcast of
    the hot keys, and only the rest is shuffled by key. NULL counts as a key.
    """
    kept = per_key.where(keep).select(F.col(key).alias("_key"))
    same = rows[key].eqNullSafe(F.col("_key"))
    if is_small(per_key):
        return rows.join(F.broadcast(kept), same, "left_semi")
    hot = hot_keys(per_key, key, n, "_key").select("_key")
    hot_kept = hot.join(kept, hot["_key"].eqNullSafe(kept["_key"]), "left_semi")
    in_place = rows.join(F.broadcast(hot_kept), same, "left_semi")
    rest = rows.join(F.broadcast(hot), same, "left_anti")
    return in_place.unionByName(rest.join(kept, same, "left_semi"))
