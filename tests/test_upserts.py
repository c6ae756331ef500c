"""The table that streams in update mode keep."""

from __future__ import annotations

import os
from datetime import datetime, timedelta

import pytest

from benchloom.storage import new_path
from benchloom.streaming import sink, windows as W
from benchloom.streaming.source import event_time, events_stream
from benchloom.streaming.table import UpsertTable
from test_streams import deliver, event, same, table

T0 = datetime(2024, 1, 1)
SCHEMA = "window_end timestamp_ntz, k long, n long"


def files(path):
    return [f for d, _, names in os.walk(path.removeprefix("file:")) for f in names if f.endswith(".parquet")]


def changes(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table_of(spark, path, every=3):
    return UpsertTable(spark, path, changes(spark, []).schema, ["window_end", "k"], every)


def batches(n):
    """Micro-batch b changes windows b, b - 1 and b - 2, one an hour; the watermark has closed those four back."""
    for b in range(n):
        rows = [(T0 + timedelta(hours=w), k, 100 * b + k) for w in range(max(0, b - 2), b + 1) for k in range(2)]
        yield b, rows, (T0 + timedelta(hours=b - 4)).isoformat() + "Z"


def newest(n):
    out = {}
    for _, rows, _ in batches(n):
        out |= {(w, k): v for w, k, v in rows}
    return out


def read(t):
    rows = t.read().collect()
    assert len({(r.window_end, r.k) for r in rows}) == len(rows)
    return {(r.window_end, r.k): r.n for r in rows}


def test_newest_rows_over_many_merges(spark):
    t = table_of(spark, new_path(spark, "upserts"))
    for b, rows, mark in batches(30):
        t.add(changes(spark, rows).coalesce(1), b, mark)
    assert read(t) == newest(30)
    known = t.manifest()
    # Closed runs are joined level by level, and what is open is little.
    assert max(level for _, level in known["closed"]) >= 1 and len(known["closed"]) <= 2 * 3
    assert t._rows(known["open"]).count() <= 14


def test_a_hundred_batches_leave_few_files(spark):
    path = new_path(spark, "upserts")
    t, most = table_of(spark, path, every=6), 0
    for b, rows, mark in batches(100):
        t.add(changes(spark, rows).coalesce(1), b, mark)
        most = max(most, len(files(path)))
    # Up to two rounds of updates, and some runs on each of three levels, by this manifest and the one before.
    assert most <= 2 * 6 + 2 * (1 + 3 * 6) and read(t) == newest(100)


@pytest.mark.parametrize("broken", ["_swap", "_remove"])
def test_a_crash_before_or_after_the_swap_loses_nothing(spark, monkeypatch, broken):
    t = table_of(spark, new_path(spark, "upserts"))
    failures = 0

    def fail(*_):
        raise OSError("lost")

    for b, rows, mark in batches(14):
        with monkeypatch.context() as m:
            m.setattr(t, broken, fail)
            try:
                t.add(changes(spark, rows), b, mark)
            except OSError:
                failures += 1
                m.undo()
                # What is read meanwhile has this batch's rows already, and the batch comes again.
                assert read(t) == newest(b + 1)
                t.add(changes(spark, rows), b, mark)
        assert read(t) == newest(b + 1)
    assert failures >= 3


def test_half_a_manifest_is_not_read(spark):
    path = new_path(spark, "upserts")
    t = table_of(spark, path)
    for b, rows, mark in batches(9):
        t.add(changes(spark, rows), b, mark)
    newer = f"{path}/manifest/99".removeprefix("file:")
    os.makedirs(newer)
    with open(f"{newer}/part-00000", "w") as f:
        f.write('{"last": 99')
    assert read(t) == newest(9)


def test_without_a_watermark_or_rows(spark):
    t = table_of(spark, new_path(spark, "upserts"), every=2)
    assert t.read().count() == 0
    for b, rows, _ in batches(5):
        t.add(changes(spark, rows), b)
    t.add(changes(spark, []), 5)
    assert t.manifest()["closed"] == [] and read(t) == newest(5)
    with pytest.raises(ValueError):
        table_of(spark, new_path(spark, "upserts"), every=1)


def test_a_stream_closes_windows_by_its_watermark(spark):
    folder = new_path(spark, "test-feed")
    rows = [event(k, 45 * k, user=k % 3, kind="ab"[k % 2]) for k in range(48)]
    for k in range(0, 48, 4):
        deliver(spark, folder, rows[k:k + 4])
    counts = W.tumbling_counts(W.watermarked(events_stream(spark, folder, max_files=1), "1 hour"), "2 hours")
    key = ["window_start", "window_end", "event_type"]
    got, _ = sink.run_upsert(counts, key, f"{folder}/out", every=3)
    assert same(got, W.tumbling_counts(event_time(table(spark, rows)), "2 hours"))
    assert UpsertTable(spark, f"{folder}/out/table", got.schema, key, 3).manifest()["closed"]
