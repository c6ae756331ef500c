"""Result store: raw run records below one folder per workload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def write_runs(df: DataFrame, path: str) -> None:
    """Append runs, partitioned by workload.

    The rebalance hint lets AQE split a workload that holds much of the data over several
    tasks and pack small ones, so neither one huge nor many tiny files come out.
    """
    df.hint("rebalance", "workload").write.partitionBy("workload").mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs as written: a workload named by digits stays a string."""
    found = spark.read.parquet(path)
    fields = [T.StructField(f.name, T.StringType()) if f.name == "workload" else f for f in found.schema]
    return spark.read.schema(T.StructType(fields)).parquet(path)
