from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from benchloom.storage import new_path
from benchloom.streaming import sink, windows as W
from benchloom.streaming.source import event_time, events_stream
from conftest import SF, plan_of

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event(n, minutes, user=1, kind="view"):
    return (n, T0 + timedelta(minutes=minutes), user, kind, 1.0, "{}")


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def deliver(spark, folder, rows):
    """Add files to an event folder."""
    table(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


def random_events(seed, n=400):
    """One user has a third of the events."""
    rng = random.Random(seed)
    return [
        event(k, rng.randrange(3 * 24 * 60), 0 if k % 3 == 0 else rng.randrange(1, 9), rng.choice(["view", "error", "buy"]))
        for k in range(n)
    ]


def same(a, b):
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


@pytest.fixture()
def folder(spark):
    return new_path(spark, "test-feed")


def test_source_reads_a_file_and_a_folder(spark, folder):
    deliver(spark, folder, [event(1, 0)])
    deliver(spark, folder, [event(2, 1)])
    got, query = sink.run_append(events_stream(spark, folder, max_files=1), f"{folder}/out")
    assert sorted(r.event_id for r in got.collect()) == [1, 2]
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 2
    whole, _ = sink.run_append(events_stream(spark, SF), f"{folder}/out2")
    assert whole.count() == spark.read.parquet(f"{SF}/events.parquet").count()


@pytest.mark.parametrize("max_files", [None, 1])
def test_stream_windows_equal_batch(spark, folder, max_files):
    rows = sorted(random_events(1), key=lambda r: r[1])
    for part in (rows[:150], rows[150:250], rows[250:]):
        deliver(spark, folder, part)
    batch = event_time(table(spark, rows))
    key = ["window_start", "window_end"]

    def stream():
        return W.watermarked(events_stream(spark, folder, max_files=max_files), "1 hour")

    cases = [
        (lambda e: W.tumbling_counts(e, "6 hours"), [*key, "event_type"]),
        (lambda e: W.sliding_counts(e, "6 hours", "2 hours"), [*key, "event_type"]),
        (lambda e: W.error_rate(e, "6 hours"), key),
    ]
    for n, (query, keys) in enumerate(cases):
        got, _ = sink.run_upsert(query(stream()), keys, f"{folder}/out{n}")
        assert same(got, query(batch))


def test_late_rows_are_dropped_and_counted(spark, folder):
    def run():
        counts = W.tumbling_counts(W.watermarked(events_stream(spark, folder), "10 minutes"), "1 hour")
        return sink.run_upsert(counts, ["window_start", "window_end", "event_type"], f"{folder}/out")

    deliver(spark, folder, [event(1, 0), event(2, 300)])
    _, query = run()
    assert sink.dropped_rows(query) == 0
    deliver(spark, folder, [event(3, 5), event(4, 295)])  # one for a closed window, one for an open one
    got, query = run()
    assert sink.dropped_rows(query) == 1
    assert sorted(r.n for r in got.collect()) == [1, 1, 1]  # 295 opens the window before that of 300
    assert got.where(F.col("window_start") == F.lit(T0).cast("timestamp_ntz")).first().n == 1


def test_topk_of_closed_windows(spark, folder):
    deliver(spark, folder, [
        event(1, 0, kind="a"), event(2, 1, kind="b"), event(3, 2, kind="b"), event(4, 3, kind="c"), event(5, 200)])
    counts = W.tumbling_counts(W.watermarked(events_stream(spark, folder), "10 minutes"), "1 hour")
    got, _ = sink.run_topk(counts, lambda batch: W.topk_per_window(batch, 2), f"{folder}/out")
    assert [(r.event_type, r.n, r.place) for r in got.orderBy("place").collect()] == [("b", 2, 1), ("a", 1, 2)]


def test_topk_limits_rows_before_the_shuffle(spark):
    counts = W.tumbling_counts(event_time(table(spark, [event(1, 0)])), "1 hour")
    assert "WindowGroupLimit" in plan_of(W.topk_per_window(counts, 2))


def test_active_users(spark, folder):
    rows = random_events(2)
    deliver(spark, folder, rows)
    batch = event_time(table(spark, rows))
    exact = {r.window_start: r.n_users for r in W.active_users(batch, "6 hours", exact=True).collect()}
    guess, _ = sink.run_upsert(
        W.active_users(W.watermarked(events_stream(spark, folder), "1 hour"), "6 hours"),
        ["window_start", "window_end"], f"{folder}/a")
    assert {r.window_start: r.n_users for r in guess.collect()} == exact  # few users: the sketch is exact
    closed, _ = sink.run_append(
        W.active_users(W.watermarked(events_stream(spark, folder), "1 hour"), "6 hours", exact=True), f"{folder}/b")
    rows = {r.window_start: r.n_users for r in closed.collect()}
    assert len(rows) >= len(exact) - 1 and all(exact[w] == n for w, n in rows.items())


def brute_sessions(rows, gap):
    out = []
    for user in {r[2] for r in rows}:
        times = sorted(r[1] for r in rows if r[2] == user)
        start = last = times[0]
        n = 1
        for t in times[1:]:
            if t - last > gap:
                out.append((user, start, last + gap, n))
                start, n = t, 0
            last, n = t, n + 1
        out.append((user, start, last + gap, n))
    return sorted(out)


def test_sessions_equal_brute_force_at_exact_gaps(spark, folder):
    gap = timedelta(minutes=30)
    rows = random_events(3) + [event(1000 + k, 5000 + 30 * k, 77) for k in range(4)] + [event(2000, 5121, 77)]
    want = brute_sessions(rows, gap)
    batch = W.sessions(event_time(table(spark, rows)), "30 minutes")
    assert sorted(tuple(r) for r in batch.select("user_id", "session_start", "session_end", "n").collect()) == want
    deliver(spark, folder, rows)
    got, _ = sink.run_append(W.sessions(W.watermarked(events_stream(spark, folder), "1 hour"), "30 minutes"), f"{folder}/out")
    mark = max(r[1] for r in rows) - timedelta(hours=1)
    rows_out = sorted(tuple(r) for r in got.select("user_id", "session_start", "session_end", "n").collect())
    assert rows_out == [s for s in want if s[2] <= mark]


def test_batch_sessions_combine_before_the_shuffle(spark):
    plan = plan_of(W.sessions(event_time(table(spark, [event(1, 0)])), "30 minutes")).split("== Physical Plan ==")[1]
    assert plan.index("Window") < plan.index("partial_min(unix_micros")


def test_dedup_keeps_one_of_each_over_batches_and_tasks(spark, folder):
    copies = [event(1, 0)] * 40 + [event(k, k) for k in range(2, 20)]
    table(spark, copies).repartition(3).write.mode("append").parquet(f"{folder}/events.parquet")
    deliver(spark, folder, [event(1, 0), event(5, 5), event(30, 30)])
    once = W.dedup_stream(events_stream(spark, folder, max_files=1), ["event_id"], "1 day")
    got, _ = sink.run_append(once, f"{folder}/out")
    assert sorted(r.event_id for r in got.collect()) == [*range(1, 20), 30]


def test_enrichment_drops_unknown_users_and_goes_on_after_a_restart(spark, folder):
    customer = spark.createDataFrame([(1, 9, "AUTO")], "c_custkey long, c_nationkey int, c_mktsegment string")
    for batch in ([event(1, 0), event(2, 1, user=5)], [event(3, 2)]):
        deliver(spark, folder, batch)
        got, _ = sink.run_append(W.enrich_stream(events_stream(spark, folder), customer), f"{folder}/out")
    assert sorted((r.event_id, r.c_nationkey) for r in got.collect()) == [(1, 9), (3, 9)]


def test_drops_are_counted_beyond_what_a_query_remembers(spark, folder):
    """Late rows in five micro-batches of one run, of which the query itself remembers fewer."""
    kept = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(kept)
    spark.conf.set(kept, "2")
    try:
        deliver(spark, folder, [event(1, 0), event(2, 3000)])
        for k in range(6):
            deliver(spark, folder, [event(10 + k, k)])
            counts = W.tumbling_counts(W.watermarked(events_stream(spark, folder, max_files=1), "10 minutes"), "1 hour")
            if k == 0:
                sink.run_upsert(counts, ["window_start", "window_end", "event_type"], f"{folder}/out")
        _, query = sink.run_upsert(counts, ["window_start", "window_end", "event_type"], f"{folder}/out")
        assert len(query.recentProgress) < 5 and sink.dropped_rows(query) == 5
    finally:
        spark.conf.set(kept, before)


def test_exact_users_combine_a_busy_user_before_the_shuffle(spark, folder):
    deliver(spark, folder, [event(1, 0)])
    users = W.active_users(W.watermarked(events_stream(spark, folder), "1 hour"), "6 hours", exact=True)
    # Without a last batch that has no events.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        query = users.writeStream.format("noop").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    plan = query._jsq.streamingQuery().lastExecution().toString().split("== Physical Plan ==")[1]
    # From the scan up: the first step that sees users sums them in its task, then comes the shuffle.
    assert plan.count("StateStoreSave") == 2
    assert "HashAggregate" in plan[plan.rindex("Exchange"):]


def test_sketches_roll_up(spark, folder):
    rows = [event(k, 7 * k, user=k % 700 if k % 5 else None) for k in range(4000)]
    sketches = W.user_sketches(event_time(table(spark, rows)), "1 day")
    whole = {r.window_start: r.n_users for r in W.active_users(event_time(table(spark, rows)), "7 days", exact=True).collect()}
    guess = {r.window_start: r.n_users for r in W.rolled_up(sketches, "7 days").collect()}
    assert guess.keys() == whole.keys() and all(abs(guess[w] - n) <= 0.05 * n for w, n in whole.items())


def test_late_rows_are_told_apart_as_the_window_drops_them(spark, folder):
    """Over micro-batches of one run, and runs that go on; what is late there is dropped by the windows."""
    batches = [[event(1, 0), event(2, 300)], [event(3, 5), event(4, 295)], [event(5, 900)], [event(6, 301), event(7, 899), event(8, 200)]]
    counts = lambda: W.tumbling_counts(W.watermarked(events_stream(spark, folder, max_files=1), "10 minutes"), "1 hour")
    dropped = 0
    for part in (batches[:1], batches[1:3], batches[3:]):
        for rows in part:
            deliver(spark, folder, rows)
        late, _ = sink.run_late(events_stream(spark, folder, max_files=1), "1 hour", "10 minutes", f"{folder}/late")
        kept, query = sink.run_upsert(counts(), ["window_start", "window_end", "event_type"], f"{folder}/kept")
        dropped += sink.dropped_rows(query)
    assert sorted(r.event_id for r in late.collect()) == [3, 6, 8]
    assert kept.agg(F.sum("n")).first()[0] == 5 and dropped == 3


def test_closed_and_open_sessions_are_all_and_settings_stay(spark, folder):
    before = spark.conf.get(sink.LOCAL_MERGE)
    rows = sorted(random_events(6), key=lambda r: r[1])
    for part in (rows[:200], rows[200:]):
        deliver(spark, folder, part)
    stream = W.sessions(W.watermarked(events_stream(spark, folder, max_files=1), "1 hour"), "30 minutes")
    closed, query = sink.run_append(stream, f"{folder}/out")
    open_ = sink.open_sessions(spark, f"{folder}/out")
    assert closed.count() and open_.count()
    assert same(closed.unionByName(open_), W.sessions(event_time(table(spark, rows)), "30 minutes"))
    assert spark.conf.get(sink.LOCAL_MERGE) == before
    # Merged before the shuffle.
    plan = query._jsq.streamingQuery().lastExecution().toString().split("== Physical Plan ==")[1]
    assert "MergingSessions" in plan[plan.rindex("Exchange"):] or "empty" in plan[plan.rindex("Exchange"):]


def test_closed_and_open_counts_are_all(spark, folder):
    rows = random_events(7)
    deliver(spark, folder, rows)
    closed, _ = sink.run_append(W.tumbling_counts(W.watermarked(events_stream(spark, folder), "1 hour"), "6 hours"), f"{folder}/out")
    everything = closed.unionByName(sink.open_counts(spark, f"{folder}/out"))
    assert same(everything, W.tumbling_counts(event_time(table(spark, rows)), "6 hours"))
