"""Log checks: which runs logged a line that matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from benchloom.operators.skew import keep_keys
from benchloom.storage import cut


def _key(logs: DataFrame) -> list[str]:
    """What names a run: its id, within its benchmark if the lines have one."""
    return ["benchmark", "run"] if "benchmark" in logs.columns else ["run"]


def _verdicts(logs: DataFrame, pattern: str, *key: str) -> DataFrame:
    matches = F.coalesce(F.col("value").rlike(pattern), F.lit(False))
    return logs.groupBy(*key).agg(F.bool_or(matches).alias("ok"), F.count("*").alias("n"))


def check_logs(logs: DataFrame, pattern: str) -> DataFrame:
    """One row per run: whether any line of its log matches the regular expression."""
    return _verdicts(logs, pattern, *_key(logs)).select(*_key(logs), "ok")


def failed_lines(logs: DataFrame, pattern: str) -> DataFrame:
    """The whole log of every run without a matching line."""
    key = _key(logs)
    if len(key) == 1:
        return keep_keys(logs, cut(_verdicts(logs, pattern, "run"), "verdicts"), "run", ~F.col("ok"))
    named = logs.withColumn("_log", F.struct(*key))
    return keep_keys(named, cut(_verdicts(named, pattern, "_log"), "verdicts"), "_log", ~F.col("ok")).drop("_log")
