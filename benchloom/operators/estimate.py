"""Ratio estimates; pi is the best-known one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POINTS_PER_PARTITION = 100_000


def ratio_estimate(df: DataFrame, inside: Column, scale: float = 1.0) -> DataFrame:
    """scale * share of rows inside the predicate, with its standard error; both NULL without rows."""
    share = F.col("n_inside") / F.nullif(F.col("n"), F.lit(0))
    return df.agg(F.count_if(inside).alias("n_inside"), F.count("*").alias("n")).select(
        "n", "n_inside", (share * scale).alias("estimate"),
        (F.sqrt(share * (1 - share) / F.nullif(F.col("n"), F.lit(0))) * scale).alias("std_error"),
    )


def in_unit_circle() -> Column:
    return F.col("x") * F.col("x") + F.col("y") * F.col("y") <= 1


def pi_estimate(spark: SparkSession, partitions: int = 10, seed: int = 42) -> DataFrame:
    """Pi from random points, `partitions` tasks of a fixed number of points each."""
    points = spark.range(partitions * POINTS_PER_PARTITION, numPartitions=partitions).select(
        F.rand(seed).alias("x"), F.rand(seed + 1).alias("y")
    )
    return ratio_estimate(points, in_unit_circle(), scale=4.0)
