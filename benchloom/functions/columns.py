"""Column helpers. Times without a zone are UTC, so the session time zone must be UTC."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Time formats of the records.
RECORD_TIME = "yyyy-MM-dd-HH:mm:ss"
MARK_TIME = "yyyy-MM-dd'T'HH:mm:ssX"
ACTION_TIME = "yyyy-MM-dd HH:mm:ss Z 'UTC'"


def field(line: Column, n: int) -> Column:
    """n-th comma-separated field, counted from 1; empty when the line is shorter."""
    return F.split_part(line, F.lit(","), F.lit(n))


def record_time(text: Column) -> Column:
    """Time of a benchmark record; NULL when malformed."""
    return F.try_to_timestamp(text, F.lit(RECORD_TIME)).cast("timestamp_ntz")


def mark_time(text: Column) -> Column:
    """Start or stop mark of a benchmark, ISO-8601 with zone."""
    return F.try_to_timestamp(text, F.lit(MARK_TIME))


def action_time(text: Column) -> Column:
    """Enqueued, started or completed time of an action."""
    return F.try_to_timestamp(text, F.lit(ACTION_TIME))


def duration_s(start: Column, stop: Column) -> Column:
    """Whole seconds between two times, each cut to its second first."""
    return F.unix_timestamp(stop) - F.unix_timestamp(start)


def queue_wait_s(timing: Column) -> Column:
    """Seconds an action waited, from a struct with `enqueued` and `started`."""
    return duration_s(timing["enqueued"], timing["started"])


def run_time_s(timing: Column) -> Column:
    """Seconds an action ran, from a struct with `started` and `completed`."""
    return duration_s(timing["started"], timing["completed"])


def throughput(size: Column, duration: Column) -> Column:
    """Size per second; NULL for a zero duration."""
    return size / F.nullif(duration, F.lit(0.0))


def run_time(run_id: Column) -> Column:
    """Time of an epoch-second run id."""
    return F.timestamp_seconds(run_id)


def uniform(seed: int | str, *parts: Column) -> Column:
    """Repeatable draw in (0, 1) from the values in `parts`.

    A digest rather than rand(): a recomputed partition gives the same draw whatever the
    partitioning was, and other SQL engines can repeat it.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0**52)
