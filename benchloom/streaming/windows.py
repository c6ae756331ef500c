"""Event-time windows. Every function takes a stream or a batch table with `ts` as timestamp."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def watermarked(events: DataFrame, delay: str) -> DataFrame:
    """Events of which a stateful operator drops those later than `delay` behind the newest."""
    return events.withWatermark("ts", delay)


def _per_window(events: DataFrame, window: Column, keys: list[str], **aggs: Column) -> DataFrame:
    return (
        events.groupBy(window.alias("w"), *keys)
        .agg(*[column.alias(name) for name, column in aggs.items()])
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            *keys, *aggs,
        )
    )


def tumbling_counts(events: DataFrame, size: str, key: str = "event_type") -> DataFrame:
    """Events per type in fixed windows."""
    return _per_window(events, F.window("ts", size), [key], n=F.count("*"))


def sliding_counts(events: DataFrame, size: str, slide: str, key: str = "event_type") -> DataFrame:
    """Events per type in overlapping windows."""
    return _per_window(events, F.window("ts", size, slide), [key], n=F.count("*"))


def error_rate(events: DataFrame, size: str, error: str = "error") -> DataFrame:
    """Share of error events per window."""
    share = F.avg(F.when(F.col("event_type") == error, 1.0).otherwise(0.0))
    return _per_window(events, F.window("ts", size), [], n=F.count("*"), error_rate=share)


# Buckets of a sketch, as a power of two: a standard error of about 1.6 percent in at most some 4 KB.
SKETCH_BITS = 12


def user_sketches(events: DataFrame, size: str) -> DataFrame:
    """A mergeable sketch of the distinct users of each window; NULL is no user.

    Kept beside its window, it can be rolled up later without the events: see `rolled_up`.
    """
    return _per_window(events, F.window("ts", size), [], users=F.hll_sketch_agg("user_id", SKETCH_BITS))


def rolled_up(sketches: DataFrame, size: str) -> DataFrame:
    """Estimated distinct users of longer windows, from the sketches of shorter ones that lie in them."""
    longer = F.window(F.col("window_start").cast("timestamp"), size)
    return _per_window(sketches, longer, [], n_users=F.hll_sketch_estimate(F.hll_union_agg("users")))


def active_users(events: DataFrame, size: str, exact: bool = False) -> DataFrame:
    """Distinct users per window; NULL is no user.

    The estimate keeps one sketch of bounded size per window. Exact counts of a stream keep every user of the open
    windows as state and come in append mode only; users are told apart first, window by window, which each task does
    for its own rows before the shuffle, so a busy user sends one row per task.
    """
    if exact and events.isStreaming:
        once = events.where(F.col("user_id").isNotNull()).groupBy(F.window("ts", size).alias("w"), "user_id").agg(F.count("*").alias("n_events"))
        return _per_window(once, F.window(F.window_time("w"), size), [], n_users=F.count("*"))
    if exact:
        return _per_window(events, F.window("ts", size), [], n_users=F.count_distinct("user_id"))
    return _per_window(events, F.window("ts", size), [], n_users=F.hll_sketch_estimate(F.hll_sketch_agg("user_id", SKETCH_BITS)))


def topk_per_window(counts: DataFrame, k: int, key: str = "event_type") -> DataFrame:
    """The k largest types of each window, ties by name."""
    order = Window.partitionBy("window_start", "window_end").orderBy(F.desc("n"), key)
    return counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def sessions(events: DataFrame, gap: str) -> DataFrame:
    """Runs of a user's events at most `gap` apart; a session ends one gap after its last event.

    Events without a time are in no session. The sinks of this library have a stream merge a user's events in each task
    first, so that a busy user shuffles sessions.
    """
    events = events.where(F.col("ts").isNotNull())
    if events.isStreaming:
        return (
            events.groupBy(F.session_window("ts", gap).alias("w"), "user_id")
            .agg(F.count("*").alias("n"))
            .select(
                "user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"),
                F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n",
            )
        )
    return _batch_sessions(events, gap)


def _batch_sessions(events: DataFrame, gap: str) -> DataFrame:
    """Sessions in two steps, so that no user's events have to meet in one task.

    Events in one gap-long slot are less than a gap apart and so share a session; they are
    combined before the shuffle. What a user has left is at most one row per slot of time.
    """
    gap_us = F.expr(f"unix_micros(timestamp_seconds(0) + interval '{gap}')")
    at = F.unix_micros("ts")
    slots = events.groupBy("user_id", (at - F.pmod(at, gap_us)).alias("slot")).agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")
    )
    by_user = Window.partitionBy("user_id").orderBy("slot")
    starts = F.col("first") - F.lag("last").over(by_user) > gap_us
    numbered = slots.withColumn("starts", F.coalesce(starts, F.lit(True)).cast("int")).withColumn(
        "session", F.sum("starts").over(by_user)
    )
    return (
        numbered.groupBy("user_id", "session")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
        .select(
            "user_id",
            F.timestamp_micros("first").cast("timestamp_ntz").alias("session_start"),
            F.timestamp_micros(F.col("last") + gap_us).cast("timestamp_ntz").alias("session_end"),
            "n",
        )
    )


def dedup_stream(events: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """Events without repeats of `keys` that come within `delay` of the first.

    Repeats are removed per input task first: a key repeated very often then reaches the
    task that decides on it as one row per input task.
    """
    return (
        events.withWatermark("ts", delay)
        .withColumn("_task", F.spark_partition_id())
        .dropDuplicatesWithinWatermark([*keys, "_task"]).drop("_task")
        .dropDuplicatesWithinWatermark(keys)
    )


def enrich_stream(events: DataFrame, customer: DataFrame) -> DataFrame:
    """Events with the nation and market segment of their user.

    The join keeps no state, so Spark plans it anew per micro-batch, with AQE: a small
    customer table is broadcast, and a busy user's events are split in a shuffled join.
    """
    users = customer.select(F.col("c_custkey").alias("user_id"), "c_nationkey", "c_mktsegment")
    return events.join(users, "user_id")
