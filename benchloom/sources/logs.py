"""Job logs and application lists: plain text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def decoded(path: Column) -> Column:
    """A path or name without its percent escapes; + stands for itself, and what is no escape stays."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their benchmark and run, from `<run>.log` files or folders anywhere below `path`.

    The benchmark is the name of the folder that a log lies in, as run ids repeat between benchmarks.
    Runs come back as `write_logs` got them: folders that Spark named have their escapes undone.
    """
    file = decoded(F.col("_metadata.file_path"))
    run = F.regexp_extract(file, r"([^/=]+)\.log(?:/|$)", 1)
    folder = F.regexp_extract(file, r"([^/]+)/(?:log=)?[^/=]+\.log(?:/|$)", 1)
    # A folder that Spark named has its value escaped once more.
    ours = file.rlike(r"/log=[^/]+\.log/")
    benchmark = F.when(ours & folder.startswith("benchmark="), decoded(F.substring(folder, len("benchmark=") + 1, 1 << 30))).otherwise(folder)
    return (
        spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(path)
        .select(benchmark.alias("benchmark"), F.when(ours, decoded(run)).otherwise(run).alias("run"), "value")
    )


def write_logs(lines: DataFrame, path: str) -> None:
    """Lay (run, value) lines out as one `<run>.log` folder per run, below a folder of the benchmark if they name one.

    `read_logs` gives the same benchmark and run back, whatever characters are in them; the benchmark of lines without one
    is the name of the folder they are written to. A NULL or empty run or benchmark cannot name a folder and is an error.
    """
    keys = ["benchmark", "run"] if "benchmark" in lines.columns else ["run"]
    named = [F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.col(k).cast("string")).otherwise(F.raise_error(f"a log without a {k}")) for k in keys]
    folders = ["benchmark", "log"][-len(keys):]
    columns = [n if f == "benchmark" else F.concat(n, F.lit(".log")) for n, f in zip(named, folders, strict=True)]
    (
        lines.select(*[c.alias(f) for c, f in zip(columns, folders, strict=True)], "value")
        .hint("rebalance", *folders)
        .write.partitionBy(*folders).option("lineSep", "\n").mode("append").text(path)
    )


def write_raw_records(report: DataFrame, path: str) -> None:
    """Keep the raw line of each record as the log of its run: (workload, run, raw), readable by `read_logs`."""
    write_logs(report.select(F.col("workload").alias("benchmark"), "run", F.col("raw").alias("value")), path)


def read_app_list(spark: SparkSession, path: str) -> DataFrame:
    """Application names, one per line."""
    return spark.read.text(path)
