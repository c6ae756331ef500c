from __future__ import annotations

import subprocess
import sys
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from benchloom.operators import estimate, history, logs
from benchloom.plans.history_plans import write_event_log
from benchloom.sources import event_log
from benchloom.sources.logs import read_logs, write_logs, write_raw_records
from conftest import plan_of


def test_read_logs_takes_run_from_file_and_folder_names(spark, tmp_path):
    (tmp_path / "PageRank").mkdir()
    (tmp_path / "PageRank" / "1449790894.log").write_text("a\nPi is roughly 3.14\n")
    (tmp_path / "7.log").write_text("b\n")
    write_logs(spark.createDataFrame([(9, "c"), (9, "d")], "run long, value string"), str(tmp_path / "more"))
    rows = {(r.run, r.value) for r in read_logs(spark, str(tmp_path)).collect()}
    assert rows == {("1449790894", "a"), ("1449790894", "Pi is roughly 3.14"), ("7", "b"), ("9", "c"), ("9", "d")}


def test_check_and_failed_lines(spark, lookup_size):
    rows = [(1, "start"), (1, "Pi is roughly 3.14"), (2, "start"), (2, "error"), (None, "lost")]
    rows += [(3, "noise")] * 50 + [(4, "noise")] * 50 + [(4, "Pi is roughly 3x")]
    log = spark.createDataFrame(rows, "run long, value string")
    checks = {r.run: r.ok for r in logs.check_logs(log, "Pi is roughly 3.").collect()}
    assert checks == {1: True, 2: False, 3: False, 4: True, None: False}
    failed = sorted(logs.failed_lines(log, "Pi is roughly 3.").collect(), key=str)
    assert failed == sorted([r for r in log.collect() if r.run in (2, 3, None)], key=str)


def test_runs_of_one_id_in_two_benchmarks(spark, tmp_path, lookup_size):
    for name, lines in (("PageRank", "start\nPi is roughly 3.14\n"), ("SVM", "start\nerror\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "1449790894.log").write_text(lines)
    log = read_logs(spark, str(tmp_path))
    assert {(r.benchmark, r.run): r.ok for r in logs.check_logs(log, "Pi is roughly 3.").collect()} == {
        ("PageRank", "1449790894"): True, ("SVM", "1449790894"): False}
    failed = logs.failed_lines(log, "Pi is roughly 3.")
    assert failed.columns == log.columns and sorted((r.benchmark, r.value) for r in failed.collect()) == [("SVM", "error"), ("SVM", "start")]


def test_job_history_and_active(spark):
    t0, t1 = datetime(2020, 1, 1), datetime(2020, 1, 1, 0, 1)
    starts = spark.createDataFrame([(1, t0), (2, t0)], "job_id long, start_ts timestamp")
    ends = spark.createDataFrame([(1, t1)], "job_id long, end_ts timestamp")
    rows = {r.job_id: (r.status, r.duration_s) for r in history.job_history(starts, ends).collect()}
    assert rows == {1: ("finished", 60), 2: ("active", None)}
    assert [r.job_id for r in history.active_jobs(starts, ends).collect()] == [2]


def test_event_log_round_trip_and_broken_tail(spark, tmp_path):
    t0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
    starts = spark.createDataFrame([("app-1", 0, t0), ("app-2", 0, t0)], "app_id string, job_id long, start_ts timestamp")
    ends = spark.createDataFrame([("app-1", 0, t0, "JobSucceeded")],
                                 "app_id string, job_id long, end_ts timestamp, result string")
    path = str(tmp_path / "log")
    write_event_log(starts, ends, path)
    single = tmp_path / "log" / "local-123.inprogress"
    single.write_text('{"Event":"SparkListenerJobStart","Job ID":5,"Submission Time":1000}\n{"Event":"SparkListenerJobE')
    log = event_log.read_event_log(spark, path)
    rows = {(r.app_id, r.job_id): r.status for r in history.job_history(
        event_log.job_starts(log), event_log.job_ends(log), ("app_id", "job_id")).collect()}
    assert rows == {("app-1", 0): "finished", ("app-2", 0): "active", ("local-123", 5): "active"}


def test_event_log_of_a_real_application(spark, tmp_path):
    job = (
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').appName('small').config('spark.ui.enabled', 'false')"
        f".config('spark.eventLog.enabled', 'true').config('spark.eventLog.dir', 'file:{tmp_path}').getOrCreate()\n"
        "s.range(10).count(); print(s.sparkContext.applicationId); s.stop()\n"
    )
    run = subprocess.run([sys.executable, "-c", job], capture_output=True, text=True, timeout=180, check=True)
    log = event_log.read_event_log(spark, str(tmp_path)).cache()
    finished = history.job_history(event_log.job_starts(log), event_log.job_ends(log), ("app_id", "job_id"))
    rows = finished.collect()
    assert rows and all(r.status == "finished" and r.result == "JobSucceeded" and r.duration_s >= 0 for r in rows)
    assert {r.app_id for r in rows} == {run.stdout.split()[-1]}
    assert log.where("event = 'SparkListenerApplicationStart' AND app_name = 'small'").count() == 1


def test_pi_is_roughly_three(spark):
    row = estimate.pi_estimate(spark, partitions=4).first()
    assert row.n == 400_000 and abs(row.estimate - 3.14159) < 5 * row.std_error < 0.02
    assert f"Pi is roughly {row.estimate}".startswith("Pi is roughly 3.1")


def test_ratio_of_a_known_share(spark):
    row = estimate.ratio_estimate(spark.range(100), F.col("id") < 25, scale=2.0).first()
    assert (row.n, row.n_inside, row.estimate) == (100, 25, 0.5)
    assert abs(row.std_error - 2 * (0.25 * 0.75 / 100) ** 0.5) < 1e-12


def test_runs_with_special_characters_come_back(spark, tmp_path):
    names = ["2015-12-10-23:41:57", "my run", "k=v", "50%", "a+b", "007"]
    write_logs(spark.createDataFrame([(n, "line") for n in names], "run string, value string"), str(tmp_path / "l"))
    assert sorted(r.run for r in read_logs(spark, str(tmp_path / "l")).collect()) == sorted(names)


def test_logs_come_back_with_their_benchmarks(spark, tmp_path):
    names = ["PageRank", "a b", "x=y", "50%", "c+d"]
    lines = spark.createDataFrame([(b, r, f"{b} {r}") for b in names for r in ("1449790894", "2015-12-10-23:41:57")], "benchmark string, run string, value string")
    write_logs(lines, str(tmp_path / "l"))
    got = read_logs(spark, str(tmp_path / "l"))
    assert got.count() == lines.count() and got.exceptAll(lines).isEmpty()
    only = read_logs(spark, str(tmp_path / "l" / "benchmark=PageRank"))
    assert {r.benchmark for r in only.collect()} == {"PageRank"}


@pytest.mark.parametrize("row", [(None, "1", "x"), ("b", None, "x"), ("", "1", "x")])
def test_a_log_needs_names(spark, tmp_path, row):
    with pytest.raises(Exception, match="a log without a"):
        write_logs(spark.createDataFrame([row], "benchmark string, run string, value string"), str(tmp_path / "l"))


def test_raw_records_are_logs_of_their_runs(spark, tmp_path):
    report = spark.createDataFrame([("PageRank", 7, "PageRank,a,1.0"), ("SVM", 7, "SVM,b,2.0")], "workload string, run long, raw string")
    write_raw_records(report, str(tmp_path / "r"))
    assert sorted(tuple(r) for r in read_logs(spark, str(tmp_path / "r")).collect()) == [("PageRank", "7", "PageRank,a,1.0"), ("SVM", "7", "SVM,b,2.0")]


def test_event_logs_of_odd_names_and_attempts(spark, tmp_path):
    t0 = datetime(2020, 1, 1, tzinfo=timezone.utc)
    apps = ["app 1", "a%b", "app-20200101-0001", "application_1577836800000_0007", "application_1577836800000_0007_1", "application_1577836800000_0007_2"]
    starts = spark.createDataFrame([(a, 0, t0) for a in apps], "app_id string, job_id long, start_ts timestamp")
    ends = spark.createDataFrame([(a, 0, t0, "JobSucceeded") for a in apps if a[-1] != "1"], "app_id string, job_id long, end_ts timestamp, result string")
    write_event_log(starts, ends, str(tmp_path / "log"))
    (tmp_path / "log" / "local-5_3").write_text('{"Event":"SparkListenerJobStart","Job ID":5,"Submission Time":1000}\n')
    jobs = event_log.logged_jobs(event_log.read_event_log(spark, str(tmp_path / "log")))
    assert {(r.app_id, r.attempt, r.job_id): r.status for r in jobs.collect()} == {
        ("app 1", None, 0): "active", ("a%b", None, 0): "finished", ("app-20200101-0001", None, 0): "active",
        ("application_1577836800000_0007", None, 0): "finished", ("application_1577836800000_0007", 1, 0): "active",
        ("application_1577836800000_0007", 2, 0): "finished", ("local-5", 3, 5): "active",
    }


def test_jobs_of_a_log_are_one_scan(spark, tmp_path):
    """Starts and ends in rolling files out of order, a job logged twice, an end without a start."""
    (tmp_path / "eventlog_v2_app").mkdir()
    line = '{{"Event":"SparkListenerJob{}","Job ID":{},"{} Time":{}{}}}\n'.format
    end = lambda job, at, result: line("End", job, "Completion", at, f',"Job Result":{{"Result":"{result}"}}')
    (tmp_path / "eventlog_v2_app" / "events_1_app").write_text(end(1, 9000, "JobSucceeded") + line("Start", 1, "Submission", 5000, "") + end(3, 1, "JobSucceeded"))
    (tmp_path / "eventlog_v2_app" / "events_2_app").write_text(line("Start", 2, "Submission", 1000, "") + line("Start", 1, "Submission", 2000, "") + end(1, 7000, "JobFailed"))
    jobs = event_log.logged_jobs(event_log.read_event_log(spark, str(tmp_path)))
    assert {(r.job_id, r.status, r.result, r.duration_s) for r in jobs.collect()} == {(1, "finished", "JobSucceeded", 7), (2, "active", None, None)}
    plan = plan_of(event_log.logged_jobs(event_log.read_event_log(spark, str(tmp_path)))).split("== Physical Plan ==")[1]
    assert plan.count("FileScan") == 1 and "Join" not in plan and "partial_max_by" in plan[plan.index("Exchange"):]
