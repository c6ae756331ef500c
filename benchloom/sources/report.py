"""Benchmark report: appended comma-separated records without a header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from benchloom.functions.columns import RECORD_TIME

# The 18 positions of a record. Fields 6 and 8 on have no documented meaning.
REPORT_SCHEMA = (
    "workload string, record_ts timestamp_ntz, duration_s double, size_mb double, throughput double, "
    "f06 string, config string, "
    + ", ".join(f"f{n:02d} string" for n in range(8, 19))
)


def parse_report(lines: DataFrame) -> DataFrame:
    """Typed record columns beside the raw line. Malformed or missing fields are NULL."""
    options = {"mode": "PERMISSIVE", "timestampNTZFormat": RECORD_TIME, "quote": ""}
    return lines.select(
        F.col("value").alias("raw"), F.from_csv("value", REPORT_SCHEMA, options).alias("r")
    ).select("raw", "r.*")


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return parse_report(spark.read.text(path))
