from __future__ import annotations

import os
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from benchloom import storage


def session(conf=None, set_dir=None, master="spark://host:7077"):
    """Stand-in for a session: only the settings that work_dir reads."""
    chosen = [set_dir]
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: chosen[0], setCheckpointDir=lambda d: chosen.__setitem__(0, d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf), sparkContext=context)


def test_folder_comes_from_the_session():
    assert storage.work_dir(session(conf="hdfs://nn/cut/")) == "hdfs://nn/cut"
    assert storage.work_dir(session(set_dir="hdfs://nn/other")) == "hdfs://nn/other"


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.work_dir(session())


def test_local_session_gets_one_temporary_folder():
    local = session(master="local[2]")
    assert storage.work_dir(local) == storage.work_dir(local)


def test_cut_ends_the_lineage(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS k").groupBy("k").count()
    kept = storage.cut(df, "test")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and kept.dtypes == df.dtypes
    assert sorted(kept.collect()) == sorted(df.collect())
    assert all(storage.work_dir(spark).split(":")[-1] in f for f in kept.inputFiles())


def test_scratch_tables_go_and_results_stay(spark):
    with storage.Scratch(spark, "test") as scratch:
        step = scratch.cut(spark.range(10), "step")
        kept = storage.cut(step.where("id > 3"), "kept")
        files = step.inputFiles()
        assert files and all(os.path.exists(f.removeprefix("file://")) for f in files)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert kept.count() == 6


def test_scratch_tables_go_after_an_error(spark):
    with pytest.raises(ZeroDivisionError), storage.Scratch(spark) as scratch:
        path = scratch.cut(spark.range(3), "step").inputFiles()[0]
        1 / 0
    assert not os.path.exists(path.removeprefix("file://"))


def test_a_cut_leaves_no_shuffle_files_and_the_setting_as_it_was(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(k).getName() for k in range(files.size())) if name.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key), shuffled()
    frame = spark.range(50_000).selectExpr("id % 997 AS k", "id").groupBy("k").agg(F.collect_list("id").alias("ids"))
    with storage.Scratch(spark) as scratch:
        storage.cut(frame, "grouped")
        first, second = (scratch.cut(frame, name).inputFiles()[0].removeprefix("file://") for name in ("first", "second"))
        scratch.drop("first")
        assert os.path.exists(second) and not os.path.exists(first)
    # They are removed in the background.
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before and spark.conf.get(key) == setting
