"""Stream source: an event table read as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = (
    "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
)


def events_stream(
    spark: SparkSession, sf_dir: str, name: str = "events", max_files: int | None = None
) -> DataFrame:
    """The event table as a stream, one file or a folder of files, `max_files` per micro-batch.

    The last letter of the path is a glob class, because a stream source takes a plain path
    for a folder and fails on a table that is one file.
    """
    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return event_time(reader.parquet(f"{sf_dir}/{name}.parque[t]"))


def event_time(events: DataFrame) -> DataFrame:
    """`ts` as an instant, as watermarks need. The session time zone must be UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))
