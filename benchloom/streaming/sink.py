"""Running streams over the data at hand into tables in the shared folder.

State and table live below `path`, so that a stream stopped or lost goes on where it was
when it is run again with the same path. No sink passes rows through the driver.
"""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from benchloom.streaming.table import UpsertTable


class _Drops(StreamingQueryListener):
    """Adds up the rows that every micro-batch of a run dropped, of which a query itself only remembers the last few; keeps its watermark."""

    def __init__(self) -> None:
        self.rows: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.news = threading.Condition()
        # Of a batch that is over, so that no later one changes what lies before it.
        self.watermark: str | None = None

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.watermark = dict(event.progress.eventTime).get("watermark", self.watermark)
        self.rows[str(event.progress.runId)] += sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def of(self, run: str) -> int:
        """The sum of a run that has ended; events come in order, its end last."""
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, timeout=60):
                raise RuntimeError("the end of the stream was not reported")
        return self.rows[run]


# Sessions are merged in each task before the shuffle. A stream keeps the settings that it was started with.
LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def _run(writer, path: str, spark: SparkSession, drops: _Drops | None = None) -> StreamingQuery:
    drops = drops or _Drops()
    before = spark.conf.get(LOCAL_MERGE)
    spark.streams.addListener(drops)
    try:
        spark.conf.set(LOCAL_MERGE, "true")
        try:
            query = writer.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        finally:
            spark.conf.set(LOCAL_MERGE, before)
        query.awaitTermination()
        query.rows_dropped = drops.of(str(query.runId))
    finally:
        spark.streams.removeListener(drops)
    return query


def _table(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.parquet(f"{path}/table")


def run_append(df: DataFrame, path: str) -> tuple[DataFrame, StreamingQuery]:
    """Rows as they become final: each closed window or session once."""
    query = _run(df.writeStream.outputMode("append").format("parquet").option("path", f"{path}/table"), path, df.sparkSession)
    return _table(df, path), query


def run_upsert(df: DataFrame, keys: list[str], path: str, every: int = 16) -> tuple[DataFrame, StreamingQuery]:
    """The newest row of each key, open windows included.

    In update mode a micro-batch gives the keys it changed; `UpsertTable` stores them under its number, which makes a
    repeated batch overwrite itself, and merges them every so many batches. Unlike complete mode this rewrites no
    closed window each time and lets the watermark free state.
    """
    table = UpsertTable(df.sparkSession, f"{path}/table", df.schema, keys, every)
    seen = _Drops()
    query = _run(
        df.writeStream.outputMode("update").foreachBatch(lambda batch, number: table.add(batch, number, seen.watermark)),
        path, df.sparkSession, seen,
    )
    return table.read(), query


def run_batches(
    df: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, mode: str = "append"
) -> StreamingQuery:
    """Apply `change` to the output of every micro-batch and store it under the batch number."""

    def store(batch: DataFrame, number: int) -> None:
        change(batch).write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    return _run(df.writeStream.outputMode(mode).foreachBatch(store), path, df.sparkSession)


def run_topk(counts: DataFrame, change: Callable[[DataFrame], DataFrame], path: str) -> tuple[DataFrame, StreamingQuery]:
    """`change` of each micro-batch of closed windows, as one table."""
    query = run_batches(counts, change, path)
    return _table(counts, path).drop("batch"), query


def open_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions that a stopped run of `sessions` into `path` still holds as state: those that the watermark has not closed."""
    state = spark.read.format("statestore").load(f"{path}/state")
    return state.select(
        "value.user_id", F.col("value.session_window.start").cast("timestamp_ntz").alias("session_start"),
        F.col("value.session_window.end").cast("timestamp_ntz").alias("session_end"), F.col("value.count").alias("n"),
    )


def open_counts(spark: SparkSession, path: str, key: str = "event_type") -> DataFrame:
    """Counts of windows that a stopped run of window counts into `path` still holds as state."""
    state = spark.read.format("statestore").load(f"{path}/state")
    return state.select(
        F.col("key.window.start").cast("timestamp_ntz").alias("window_start"), F.col("key.window.end").cast("timestamp_ntz").alias("window_end"),
        F.col(f"key.{key}").alias(key), F.col("value.count").alias("n"),
    )


def run_late(events: DataFrame, size: str, delay: str, path: str) -> tuple[DataFrame, StreamingQuery]:
    """The events that windows of `size` under a watermark of `delay` leave out, as rows, with their window's end.

    A stateful operator only counts what it drops. Here every micro-batch stores the newest time it saw, after the
    events whose window the watermark had closed before it: that of the newest time of all batches before, less the
    delay. So a batch that is repeated, or a run that goes on later, decides the same. Events without a time are left out
    by windows too, but are not late.
    """
    spark = events.sparkSession
    schema = events.schema

    def store(batch: DataFrame, number: int) -> None:
        known = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/seen")
        mark = F.max("newest") - F.expr(f"interval {delay}")
        closed = known.where(F.col("batch") < number).agg(mark.alias("mark")).first()["mark"]
        end = F.window("ts", size)["end"]
        late = batch.withColumn("window_end", end).where(F.col("window_end") <= F.lit(closed).cast("timestamp"))
        late.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
        seen = batch.agg(F.max("ts").alias("newest"), F.lit(number).cast("long").alias("batch"))
        seen.write.mode("overwrite").parquet(f"{path}/seen/part={number}")

    # So that there is something to read before the first batch.
    spark.createDataFrame([], "newest timestamp, batch long").write.mode("overwrite").parquet(f"{path}/seen/part=-1")
    query = _run(events.writeStream.foreachBatch(store), path, spark)
    fields = [*schema.fields, StructField("window_end", TimestampType()), StructField("batch", LongType())]
    return spark.read.schema(StructType(fields)).parquet(f"{path}/late").drop("batch"), query


def dropped_rows(query: StreamingQuery) -> int:
    """Rows that a run of this module left out for being behind the watermark, over all its micro-batches.

    Stateful operators count after combining rows within a task, so this is the number of
    partial results, not of events.
    """
    return query.rows_dropped
