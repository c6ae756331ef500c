"""Missing values and odd names that the SQL comparison does not see."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from benchloom.operators import estimate, ratings, records, skew
from benchloom.sources.runs import read_runs, write_runs
from benchloom.storage import cut
from benchloom.streaming import windows


def test_rank_keeps_null_keys_and_values(spark):
    rows = [(1, None, "d", 2.0, "asc"), (2, None, "d", 1.0, "asc"), (3, "w", "d", None, "asc"), (4, "w", "d", 5.0, "asc")]
    frame = spark.createDataFrame(rows, "run long, workload string, name string, value double, direction string")
    assert {r.run: r["rank"] for r in records.rank_runs(frame, "run").collect()} == {1: 2, 2: 1, 3: None, 4: 1}


def test_estimate_of_no_rows(spark):
    row = estimate.ratio_estimate(spark.range(0), F.col("id") > 1).first()
    assert (row.n, row.estimate, row.std_error) == (0, None, None)


def test_workload_of_digits_stays_text(spark, tmp_path):
    write_runs(spark.createDataFrame([(1, "007"), (2, "12")], "run long, workload string"), f"{tmp_path}/runs")
    assert {r.workload for r in read_runs(spark, f"{tmp_path}/runs").collect()} == {"007", "12"}


def test_events_without_time_are_in_no_session(spark):
    events = spark.createDataFrame([(1, datetime(2024, 1, 1)), (1, None)], "user_id long, ts timestamp")
    assert windows.sessions(events, "30 minutes").select("n").collect()[0].n == 1
    assert windows.sessions(events, "30 minutes").count() == 1


def test_svdpp_estimates_lie_within_the_ratings(spark):
    rows = [(1, 1, 50.0), (1, 2, 60.0), (2, 1, 70.0)]
    frame = spark.createDataFrame(rows, "user long, item long, rating double")
    model = ratings.svdpp(frame, rank=2, iters=1, rate=0.01)
    got = [r.prediction for r in model.predict(frame).collect()]
    assert model.bounds == (50.0, 70.0) and all(50 <= x <= 70 for x in got)


def test_long_application_line_has_only_starts_as_long_as_a_name(spark):
    apps = spark.createDataFrame([("ab" * 10_000,), ("a",), (None,)], "value string")
    names = spark.createDataFrame([("ab",), ("a",), ("",), ("abb",), (None,)], "benchmark string")
    starts = records._prefixes(apps, names, "benchmark")
    assert starts.agg(F.max(F.length("start"))).first()[0] == 3 and starts.count() == 4 + 2
    counts = {r.benchmark: r.n_apps for r in records.app_counts(apps, names).collect()}
    assert counts == {"ab": 1, "a": 2, "": 2, "abb": 0, None: 0}
    none = records.app_counts(apps, names.where("benchmark IS NULL")).collect()
    assert [r.n_apps for r in none] == [0]


def test_lookup_of_many_bytes_is_not_broadcast(spark):
    few = cut(spark.range(20_000), "few")
    wide = cut(spark.range(20_000).select("id", *[F.col("id").cast("double").alias(f"q{k}") for k in range(500)]), "wide")
    long = cut(spark.range(20_000).select("id", F.repeat(F.lit("x"), 5_000).alias("text")), "long")
    listed = cut(spark.range(2_000).select("id", F.array_repeat(F.lit("x"), 20_000).alias("texts")), "listed")
    assert [skew.is_small(t) for t in (few, wide, long, listed)] == [True, False, False, False]
