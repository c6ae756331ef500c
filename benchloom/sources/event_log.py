"""Spark's job-history event log as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from benchloom.functions.columns import duration_s
from benchloom.sources.logs import decoded

# The event fields kept; the log's own names.
EVENT_SCHEMA = (
    "Event string, `Job ID` long, `Submission Time` long, `Completion Time` long, "
    "`Job Result` struct<Result: string>, `App ID` string, `App Name` string, Timestamp long"
)


def _log_name() -> Column:
    """Name of the application log that a file belongs to: its rolling folder, or the file itself."""
    path = decoded(F.col("_metadata.file_path"))
    folder = F.regexp_extract(path, r"/(?:log=)?eventlog_v2_([^/]+)/[^/]*$", 1)
    named = F.when(path.rlike(r"/log=eventlog_v2_[^/]+/[^/]*$"), decoded(folder)).otherwise(folder)
    return F.when(folder != "", named).otherwise(F.regexp_extract(path, r"([^/]+?)(?:\.inprogress|\.zstd|\.lz4|\.snappy|\.lzf)*$", 1))


# Ids of cluster managers end in numbers of their own; a further number after an underscore is the attempt.
_ATTEMPT = r"^(application_\d+_\d+|.*?)(?:_(\d+))?$"


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Events of all applications below `path`, from single-file or rolling logs, with the attempt where a log names one.

    A log that is still being written may end in half a line, which is left out.
    """
    attempt = F.regexp_extract("log", _ATTEMPT, 2)
    return (
        spark.read.schema(EVENT_SCHEMA)
        .option("recursiveFileLookup", "true").option("mode", "PERMISSIVE").json(path)
        .select("*", _log_name().alias("log"))
        .select(
            F.regexp_extract("log", _ATTEMPT, 1).alias("app_id"),
            F.when(attempt != "", attempt.cast("int")).alias("attempt"),
            F.col("Event").alias("event"),
            F.col("Job ID").alias("job_id"),
            F.timestamp_millis("Submission Time").alias("submitted"),
            F.timestamp_millis("Completion Time").alias("completed"),
            F.col("Job Result.Result").alias("result"),
            F.col("App Name").alias("app_name"),
            F.timestamp_millis("Timestamp").alias("at"),
        )
        .where(F.col("event").isNotNull())
    )


def logged_jobs(log: DataFrame) -> DataFrame:
    """Every started job of a log with start, end, result, status and duration, one row per application, attempt and job.

    One pass: starts and ends of a job fold into one row, in each task before the shuffle. Of a job that was logged
    twice the first start and the last end count. Jobs without a start are left out.
    """
    ended = F.col("event") == "SparkListenerJobEnd"
    folded = log.where(F.col("event").isin("SparkListenerJobStart", "SparkListenerJobEnd")).groupBy("app_id", "attempt", "job_id").agg(
        F.min(F.when(~ended, F.col("submitted"))).alias("start_ts"), F.max(F.when(ended, F.col("completed"))).alias("end_ts"),
        F.max_by(F.when(ended, F.col("result")), F.when(ended, F.col("completed"))).alias("result"),
    )
    return folded.where(F.col("start_ts").isNotNull()).withColumns({
        "status": F.when(F.col("end_ts").isNull(), "active").otherwise("finished"), "duration_s": duration_s(F.col("start_ts"), F.col("end_ts")),
    })


def job_starts(log: DataFrame) -> DataFrame:
    return log.where(F.col("event") == "SparkListenerJobStart").select(
        "app_id", "job_id", F.col("submitted").alias("start_ts")
    )


def job_ends(log: DataFrame) -> DataFrame:
    return log.where(F.col("event") == "SparkListenerJobEnd").select(
        "app_id", "job_id", F.col("completed").alias("end_ts"), "result"
    )
