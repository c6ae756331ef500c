"""Job history: started jobs against ended ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from benchloom.functions.columns import duration_s


def job_history(starts: DataFrame, ends: DataFrame, key: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Every started job with its end, status and duration in seconds."""
    return (
        starts.join(ends, list(key), "left")
        .withColumn("status", F.when(F.col("end_ts").isNull(), "active").otherwise("finished"))
        .withColumn("duration_s", duration_s(F.col("start_ts"), F.col("end_ts")))
    )


def active_jobs(starts: DataFrame, ends: DataFrame, key: tuple[str, ...] = ("job_id",)) -> DataFrame:
    """Jobs that started and have not ended."""
    return starts.join(ends, list(key), "left_anti")
