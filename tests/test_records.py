from __future__ import annotations

import random
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from benchloom.operators import records
from benchloom.sources.logs import read_app_list
from benchloom.sources.report import parse_report, read_report
from benchloom.sources.runs import read_runs, write_runs
from conftest import plan_of
from test_columns import LINE


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


REPORT = [
    LINE,
    "SVM,2016-01-01-00:00:00,3.5,7.0,2.0",
    "PageRank,2016-03-01-00:00:00,10.0,20.0,2.0,0,old-SVM-Config",
    "PageRank,2016-02-01-00:00:00,12.0,20.0,1.7",
]


def test_parse_published_record(spark):
    row = parse_report(lines(spark, LINE)).first()
    assert row.workload == "PageRank" and row.record_ts == datetime(2015, 12, 10, 23, 41, 57)
    assert (row.duration_s, row.size_mb, row.throughput) == (77.939, 71.888079, 0.922363)
    assert (row.f06, row.config, row.f08, row.f12, row.f18) == ("0", "PageRank-MLlibConfig", None, "10", "0.15")
    assert row.raw == LINE


def test_parse_keeps_malformed_lines_with_nulls(spark):
    rows = parse_report(lines(spark, "x,not-a-time,abc,1", '"a,2016-01-01-00:00:00,1', "")).collect()
    assert len(rows) == 3
    assert rows[0].workload == "x" and rows[0].record_ts is None and rows[0].duration_s is None and rows[0].size_mb == 1
    assert rows[1].workload == '"a' and rows[1].duration_s == 1
    assert rows[2].workload is None


def test_read_report_file(spark, tmp_path):
    (tmp_path / "bench-report.dat").write_text("\n".join(REPORT) + "\n")
    assert read_report(spark, str(tmp_path)).count() == 4


def test_key_match_anywhere_or_exact(spark):
    report = parse_report(lines(spark, *REPORT))
    assert records.records_for(report, "SVM").count() == 2
    assert records.records_for(report, "SVM", exact=True).count() == 1
    assert records.records_for(report, "svm").count() == 0


def test_latest_in_any_row_order(spark):
    for seed in range(3):
        rows = REPORT[:]
        random.Random(seed).shuffle(rows)
        report = parse_report(lines(spark, *rows)).repartition(3)
        newest = {r.workload: r.duration_s for r in records.latest_per_key(report, "workload", ["record_ts"]).collect()}
        assert newest == {"PageRank": 10.0, "SVM": 3.5}
        assert records.latest(report, "PageRank", ["record_ts"]).first().duration_s == 10.0


def test_latest_per_key_keeps_one_row_per_task_before_the_shuffle(spark):
    report = parse_report(lines(spark, *REPORT))
    plan = plan_of(records.latest_per_key(report, "workload", ["record_ts"]))
    shuffle = plan.rindex("Exchange hashpartitioning")
    assert "Partial" in plan[shuffle:] and "WindowGroupLimit" in plan[shuffle:]


def test_long_metrics_and_best(spark):
    runs = spark.createDataFrame(
        [(1, "a", 3.0, 3.0), (2, "a", 1.0, 1.0), (3, "a", 2.0, None), (4, "a", 1.0, 3.0)],
        "run long, workload string, duration_s double, throughput double",
    )
    metrics = records.unpivot_metrics(runs, "run", "workload")
    assert {tuple(r) for r in metrics.where("run = 1").collect()} == {
        (1, "a", "duration", 3.0, "secs", "asc"), (1, "a", "throughput", 3.0, "x/sec", "desc")}
    best = {r.name: (r.run, r.value) for r in records.best_run(metrics, "run").collect()}
    assert best == {"duration": (2, 1.0), "throughput": (1, 3.0)}


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_ranks_equal_pandas_with_a_hot_group_and_ties(spark, levels):
    rng = random.Random(levels)
    rows = [
        (n, "hot" if n % 3 else rng.choice("abcd"), rng.choice(["duration", "throughput"]), float(rng.randrange(levels)))
        for n in range(3000)
    ]
    frame = pd.DataFrame(rows, columns=["run", "workload", "name", "value"])
    frame["direction"] = frame["name"].map({"duration": "asc", "throughput": "desc"})
    signed = frame["value"].where(frame["direction"] == "asc", -frame["value"])
    want = signed.groupby([frame["workload"], frame["name"]]).rank(method="min").astype(int)
    ranked = records.rank_runs(spark.createDataFrame(frame).repartition(5), "run").toPandas().set_index("run")
    assert (ranked["rank"].sort_index().values == want.values).all()


def test_rank_cuts_a_group_into_slices(spark):
    rows = spark.range(20_000).selectExpr(
        "id AS run", "'one' AS workload", "'duration' AS name", "double(id) AS value", "'asc' AS direction"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = records.rank_runs(rows, "run").withColumn("task", F.spark_partition_id())
        assert ranked.select("task").distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert ranked.where("rank <> run + 1").isEmpty()


def test_catalog_lookup_drops_unknown_actions(spark):
    runs = spark.createDataFrame([(1, "matrixfactorization"), (2, "sparkpi"), (3, "sql")], "run long, action string")
    found = {r.run: (r.benchmark, r.result_key) for r in records.with_catalog(runs, records.catalog(spark)).collect()}
    assert found == {1: ("MatrixFactorization", "MF"), 3: ("SQL", "sql")}


def test_validity_by_prefix(spark, lookup_size):
    apps = lines(spark, "PageRank/bin", "SVM", "SVMplus", "")
    names = ["PageRank"] * 20 + ["SVM", "SVMp", "SVMx", "agerank", "", None, "PageRank/bin", "PageRank/binx"]
    runs = spark.createDataFrame(list(enumerate(names)), "run long, workload string")

    def known(name):
        return name is not None and any(a.startswith(name) for a in ["PageRank/bin", "SVM", "SVMplus", ""])

    valid = {r.run for r in records.valid_runs(runs, apps).collect()}
    invalid = {r.run for r in records.invalid_runs(runs, apps).collect()}
    assert valid == {n for n, name in enumerate(names) if known(name)}
    assert invalid == {n for n, name in enumerate(names) if not known(name)}


def test_app_list_and_counts(spark, tmp_path):
    (tmp_path / "applications.lst").write_text("SVM\nSVMplus\nPageRank\n")
    apps = read_app_list(spark, str(tmp_path / "applications.lst"))
    counts = records.app_counts(apps, records.catalog(spark))
    assert {r.benchmark: r.n_apps for r in counts.collect() if r.n_apps} == {"SVM": 2, "PageRank": 1}
    assert counts.count() == 8
    assert [r.value for r in records.known_apps(apps, "SVM").orderBy("value").collect()] == ["SVM", "SVMplus"]


def test_run_store_appends_and_prunes(spark, tmp_path):
    path = str(tmp_path / "runs")
    report = parse_report(lines(spark, *REPORT))
    write_runs(report, path)
    write_runs(report.where("workload = 'SVM'"), path)
    runs = read_runs(spark, path)
    assert runs.count() == 5
    assert (tmp_path / "runs" / "workload=PageRank").is_dir()
    plan = plan_of(records.records_for(runs, "SVM", exact=True))
    assert "PartitionFilters: [isnotnull(workload" in plan


def test_composite_score_is_the_duration(spark):
    runs = spark.createDataFrame([(1, "a", 3.5, 2.0), (2, "a", None, 1.0)], "run long, workload string, duration_s double, throughput double")
    got = records.composite(records.unpivot_metrics(runs, "run", "workload"), "run", "workload").collect()
    assert [tuple(r) for r in got] == [(1, "a", 3.5, "secs", "asc")]
