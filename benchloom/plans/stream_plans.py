"""Stream workloads on the event table, and their batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.plans.registry import Registry
from benchloom.sources.tables import load
from benchloom.storage import new_path
from benchloom.streaming import sink, windows as W
from benchloom.streaming.source import event_time, events_stream

registry = Registry()
query = registry.query

DAY = "INTERVAL 1 DAY"


def _stream(spark, d):
    return W.watermarked(events_stream(spark, d), "1 day")


def _batch(spark, d):
    return event_time(load(spark, d, "events"))


def _upsert(df, name, *keys):
    keys = ["window_start", "window_end", *keys]
    return sink.run_upsert(df, keys, new_path(df.sparkSession, name))[0]


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_events(spark, d):
    """The source itself: every event once."""
    table, _ = sink.run_append(events_stream(spark, d), new_path(spark, "events"))
    return table.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


_TUMBLING = f"""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end,
           event_type, count(*) AS n
    FROM events GROUP BY ALL
"""
_SLIDING = f"""
    SELECT start AS window_start, start + {DAY} AS window_end, event_type, count(*) AS n
    FROM (
        SELECT event_type, unnest([half, half - INTERVAL 12 HOUR]) AS start
        FROM (SELECT event_type, time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') AS half FROM events))
    GROUP BY ALL
"""
_ERRORS = f"""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end,
           count(*) AS n, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate
    FROM events GROUP BY ALL
"""


@query(_TUMBLING)
def tumbling_counts(spark, d):
    return W.tumbling_counts(_batch(spark, d), "1 day")


@query(_TUMBLING)
def stream_tumbling_counts(spark, d):
    return _upsert(W.tumbling_counts(_stream(spark, d), "1 day"), "tumbling", "event_type")


@query(_SLIDING)
def sliding_counts(spark, d):
    return W.sliding_counts(_batch(spark, d), "1 day", "12 hours")


@query(_SLIDING)
def stream_sliding_counts(spark, d):
    return _upsert(W.sliding_counts(_stream(spark, d), "1 day", "12 hours"), "sliding", "event_type")


@query(f"""
    SELECT * FROM ({_TUMBLING}) WHERE window_end <= (SELECT max(ts) FROM events) - {DAY}
    QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) <= 2
""".replace("SELECT * FROM (", """SELECT *, row_number() OVER (
        PARTITION BY window_start ORDER BY n DESC, event_type)::INT AS place FROM (""", 1))
def stream_topk(spark, d):
    """The two most frequent types of each window the watermark has closed."""
    counts = W.tumbling_counts(_stream(spark, d), "1 day")
    return sink.run_topk(counts, lambda batch: W.topk_per_window(batch, 2), new_path(spark, "topk"))[0]


@query(_ERRORS)
def error_rate(spark, d):
    return W.error_rate(_batch(spark, d), "1 day").withColumn("error_rate", F.round("error_rate", 6))


@query(_ERRORS)
def stream_error_rate(spark, d):
    return _upsert(W.error_rate(_stream(spark, d), "1 day"), "errors").withColumn(
        "error_rate", F.round("error_rate", 6)
    )


@query(f"""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end,
           count(DISTINCT user_id) AS n_users
    FROM events GROUP BY ALL
""")
def active_users(spark, d):
    return W.active_users(_batch(spark, d), "1 day", exact=True)


# Estimates lie within this share of the exact counts, or one user: three standard errors.
BAND = 0.05


@query(f"""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end,
           count(DISTINCT user_id) AS n_exact, true AS within_band
    FROM events GROUP BY ALL
""")
def stream_active_users(spark, d):
    """Estimated distinct users per day from a stream, held against exact counts of the table."""
    guess = _upsert(W.active_users(_stream(spark, d), "1 day"), "active").withColumnRenamed("n_users", "guess")
    exact = W.active_users(_batch(spark, d), "1 day", exact=True).withColumnRenamed("n_users", "n_exact")
    off = F.abs(F.col("guess") - F.col("n_exact"))
    return exact.join(guess, ["window_start", "window_end"], "left").select(
        "window_start", "window_end", "n_exact",
        F.coalesce(off <= F.greatest(F.lit(1.0), BAND * F.col("n_exact")), F.lit(False)).alias("within_band"),
    )


@query(f"""
    SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS window_start,
           time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 7 DAY AS window_end,
           count(DISTINCT user_id) AS n_exact, true AS within_band
    FROM events GROUP BY ALL
""")
def stream_weekly_users(spark, d):
    """Daily sketches kept by a stream and rolled up to weeks, held against exact counts of the table."""
    days = _upsert(W.user_sketches(_stream(spark, d), "1 day"), "sketches")
    guess = W.rolled_up(days, "7 days").withColumnRenamed("n_users", "guess")
    exact = W.active_users(_batch(spark, d), "7 days", exact=True).withColumnRenamed("n_users", "n_exact")
    off = F.abs(F.col("guess") - F.col("n_exact"))
    return exact.join(guess, ["window_start", "window_end"], "left").select(
        "window_start", "window_end", "n_exact",
        F.coalesce(off <= F.greatest(F.lit(1.0), BAND * F.col("n_exact")), F.lit(False)).alias("within_band"),
    )


@query(f"""
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end,
           count(DISTINCT user_id) AS n_users
    FROM events WHERE date_trunc('day', ts) + {DAY} <= (SELECT max(ts) FROM events) - {DAY} GROUP BY ALL
""")
def stream_active_users_exact(spark, d):
    """Distinct users of each day the watermark has closed."""
    users = W.active_users(_stream(spark, d), "1 day", exact=True)
    return sink.run_append(users, new_path(spark, "active-exact"))[0]


_SESSIONS = """
    SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n
    FROM (
        SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session
        FROM (
            SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts)
                <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh
            FROM events))
    GROUP BY user_id, session
"""


@query(_SESSIONS)
def sessions(spark, d):
    return W.sessions(_batch(spark, d), "30 minutes")


@query(f"SELECT * FROM ({_SESSIONS}) WHERE session_end <= (SELECT max(ts) FROM events) - {DAY}")
def stream_sessions(spark, d):
    """Sessions the watermark has closed."""
    return sink.run_append(W.sessions(_stream(spark, d), "30 minutes"), new_path(spark, "sessions"))[0]


@query(_SESSIONS)
def stream_all_sessions(spark, d):
    """Sessions of a backlog to its end: those the watermark has closed, and those still open."""
    path = new_path(spark, "all-sessions")
    closed, _ = sink.run_append(W.sessions(_stream(spark, d), "30 minutes"), path)
    return closed.unionByName(sink.open_sessions(spark, path))


@query(f"""
    SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type)::INT AS place FROM ({_TUMBLING})
    QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY n DESC, event_type) <= 2
""")
def stream_all_topk(spark, d):
    """The two most frequent types of each window, open ones included."""
    path = new_path(spark, "all-topk")
    closed, _ = sink.run_append(W.tumbling_counts(_stream(spark, d), "1 day"), path)
    return W.topk_per_window(closed.unionByName(sink.open_counts(spark, path)), 2)


@query(f"""
    WITH mark AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_type <> 'error')
    SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + {DAY} AS window_end, event_type, count(*) AS n
    FROM events, mark
    WHERE event_type <> 'error' OR date_trunc('day', ts) + {DAY} > mark GROUP BY ALL
""")
def stream_late_events(spark, d):
    """Error events delivered after all others: those of closed windows are dropped."""
    feed, out = new_path(spark, "feed"), new_path(spark, "late")
    events = load(spark, d, "events")
    late = F.col("event_type") == "error"
    for delivery in (events.where(~late), events.where(late)):
        delivery.write.mode("append").parquet(f"{feed}/events.parquet")
        counts = W.tumbling_counts(W.watermarked(events_stream(spark, feed), "2 days"), "1 day")
        table, _ = sink.run_upsert(counts, ["window_start", "window_end", "event_type"], out)
    return table


@query(f"""
    WITH mark AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events WHERE event_type <> 'error')
    SELECT event_id, user_id, date_trunc('day', ts) + {DAY} AS window_end FROM events, mark
    WHERE event_type = 'error' AND date_trunc('day', ts) + {DAY} <= mark
""")
def stream_dropped(spark, d):
    """The events that `stream_late_events` leaves out, as rows."""
    feed, out = new_path(spark, "feed"), new_path(spark, "dropped")
    events = load(spark, d, "events")
    late = F.col("event_type") == "error"
    for delivery in (events.where(~late), events.where(late)):
        delivery.write.mode("append").parquet(f"{feed}/events.parquet")
        table, _ = sink.run_late(events_stream(spark, feed), "1 day", "2 days", out)
    return table.select("event_id", "user_id", F.col("window_end").cast("timestamp_ntz").alias("window_end"))


@query("SELECT event_id, ts, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """Every event delivered twice, and kept once."""
    twice = events_stream(spark, d).unionByName(events_stream(spark, d))
    once = W.dedup_stream(twice, ["event_id"], "1 day")
    table, _ = sink.run_append(once, new_path(spark, "dedup"))
    return table.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")


@query("""
    SELECT event_id, event_type, user_id, c_nationkey, c_mktsegment FROM events JOIN customer ON user_id = c_custkey
""")
def stream_enriched(spark, d):
    joined = W.enrich_stream(events_stream(spark, d), load(spark, d, "customer"))
    table, _ = sink.run_append(joined, new_path(spark, "enriched"))
    return table.select("event_id", "event_type", "user_id", "c_nationkey", "c_mktsegment")
