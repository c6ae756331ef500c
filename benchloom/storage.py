"""Shared-folder storage: cutting lineage and keeping stream state where every executor sees it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir.

    A temporary folder is made only for a local master that names none; on a cluster a
    machine-local folder would lose the data with its executor, so that is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="benchloom-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/benchloom/{name}-{uuid.uuid4().hex}"


# Whether Spark removes the shuffle files of a query as soon as it ends.
_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in the block leave no shuffle files; else these stay until the driver collects its garbage."""
    before = spark.conf.get(_REMOVE_SHUFFLES)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_REMOVE_SHUFFLES, before)


def _stored(df: DataFrame, path: str) -> DataFrame:
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends in replicated files.

    Used where a frame has several consumers or a loop would grow the plan. A table keeps
    real sizes for the join planner, and a lost executor costs a re-read, not a re-run. What was shuffled for it is removed.
    """
    return _stored(df, new_path(df.sparkSession, name))


class Scratch:
    """Tables that only live until a step is done: `with Scratch(spark) as scratch: scratch.cut(df, name)`.

    All of them are removed when the block ends, also by an error, so a loop leaves no more than it returns.
    What outlives the block has to be written by the plain `cut` before, as frames are lazy.
    """

    def __init__(self, spark: SparkSession, name: str = "scratch") -> None:
        self.spark, self.path, self.paths = spark, new_path(spark, name), {}

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.path}/{name}-{uuid.uuid4().hex}"
        self.paths.setdefault(name, []).append(path)
        return _stored(df, path)

    def drop(self, *names: str) -> None:
        """Remove the tables of these names before the step is done."""
        for name in names:
            for path in self.paths.pop(name):
                self._remove(path)

    def close(self) -> None:
        self._remove(self.path)

    def _remove(self, path: str) -> None:
        context = self.spark.sparkContext
        at = context._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()
