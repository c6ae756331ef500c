"""Benchmark records: filter, project, look up, pick the latest or best, rank."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from benchloom.operators.skew import keep_keys
from benchloom.storage import cut

# Action name, benchmark name, key of its records in the report.
CATALOG = [
    ("logisticregression", "LogisticRegression", "LogisticRegression"),
    ("matrixfactorization", "MatrixFactorization", "MF"),
    ("pagerank", "PageRank", "PageRank"),
    ("sql", "SQL", "sql"),
    ("streaming", "Streaming", "streaming"),
    ("svdplusplus", "SVDPlusPlus", "SVDPlusPlus"),
    ("svm", "SVM", "SVM"),
    ("trianglecount", "TriangleCount", "TriangleCount"),
]

# Metric name, record column, units, direction (asc: smaller is better).
METRICS = [
    ("duration", "duration_s", "secs", "asc"),
    ("throughput", "throughput", "x/sec", "desc"),
]

# Fixed value: the metric that is a run's composite score.
COMPOSITE = "duration"


def catalog(spark: SparkSession) -> DataFrame:
    rows = ", ".join(str(row) for row in CATALOG)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS catalog(action, benchmark, result_key)")


def records_for(report: DataFrame, key: str, exact: bool = False) -> DataFrame:
    """Records with `key` anywhere in the line, case-sensitive; `exact` matches the workload only.

    Exact mode prunes partitions of a stored run table; the free match has to read every line.
    """
    return report.where(F.col("workload") == key if exact else F.col("raw").contains(key))


def run_metrics(report: DataFrame, *keep: str) -> DataFrame:
    """Duration and throughput of each record, beside the columns in `keep`."""
    return report.select("workload", "record_ts", *keep, "duration_s", "throughput")


def with_catalog(runs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Benchmark and result key of each run's action; runs of unknown actions drop out.

    No broadcast hint: Spark broadcasts the catalog by its size, and shuffles one that grew.
    """
    return runs.join(catalog, "action")


def _prefixes(apps: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """Starts of every application line as long as some name, so that prefix matches become equi-joins.

    Only the distinct lengths of the names come to the driver: a long line has no more starts than there are such lengths.
    """
    lengths = names.select(F.length(name).alias("n")).where("n IS NOT NULL").distinct().toArrow()["n"].to_pylist()
    if not lengths:
        return apps.select(F.col("value").alias("start")).where(F.lit(False))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("value"))
    return apps.select(F.explode(F.transform(fitting, lambda n: F.left("value", n))).alias("start"))


def known_apps(apps: DataFrame, name: str) -> DataFrame:
    """Application lines that start with `name`."""
    return apps.where(F.col("value").startswith(name))


def app_counts(apps: DataFrame, names: DataFrame, name: str = "benchmark") -> DataFrame:
    """How many application lines start with each name; 0 for names without one."""
    counts = _prefixes(apps, names, name).groupBy("start").agg(F.count("*").alias("n_apps"))
    return names.join(counts, F.col(name) == F.col("start"), "left").select(
        names["*"], F.coalesce("n_apps", F.lit(0)).alias("n_apps")
    )


def _known(runs: DataFrame, apps: DataFrame, name: str) -> DataFrame:
    """Each workload once, with its count and whether it starts some application line."""
    names = cut(runs.groupBy(name).agg(F.count("*").alias("n")), "names")
    starts = _prefixes(apps, names, name).distinct().withColumn("known", F.lit(True))
    return cut(
        names
        .join(starts, F.col(name) == F.col("start"), "left")
        .select(name, "n", F.coalesce("known", F.lit(False)).alias("known")),
        "known",
    )


def valid_runs(runs: DataFrame, apps: DataFrame, name: str = "workload") -> DataFrame:
    """Runs whose workload starts some application line."""
    return keep_keys(runs, _known(runs, apps, name), name, F.col("known"))


def invalid_runs(runs: DataFrame, apps: DataFrame, name: str = "workload") -> DataFrame:
    """Runs whose workload starts no application line."""
    return keep_keys(runs, _known(runs, apps, name), name, ~F.col("known"))


def latest_per_key(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """Last row of each key in `order`, which should end in a unique column.

    Spark keeps one row per key in every map task before the shuffle (WindowGroupLimit), so a
    key with a third of all rows still sends only as many rows as there are tasks.
    """
    keys = [key] if isinstance(key, str) else key
    newest = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") == 1).drop("_n")


def latest(report: DataFrame, key: str, order: list[str], exact: bool = False) -> DataFrame:
    """Last record of one key."""
    return records_for(report, key, exact).orderBy(*[F.desc(c) for c in order]).limit(1)


def unpivot_metrics(runs: DataFrame, *ids: str) -> DataFrame:
    """One row per run and metric, with units and direction."""
    rows = [
        F.struct(
            F.lit(name).alias("name"), F.col(column).alias("value"),
            F.lit(units).alias("units"), F.lit(direction).alias("direction"),
        )
        for name, column, units, direction in METRICS
    ]
    return runs.select(*ids, F.inline(F.array(*rows)))


def composite(metrics: DataFrame, *ids: str) -> DataFrame:
    """The one headline value of each run, with its units and direction: its duration. Runs without one have none."""
    kept = metrics.where((F.col("name") == COMPOSITE) & F.col("value").isNotNull())
    return kept.select(*ids, F.col("value").alias("score"), "units", "direction")


def _score() -> Column:
    """Value signed so that smaller is better."""
    return F.when(F.col("direction") == "asc", F.col("value")).otherwise(-F.col("value"))


def best_run(metrics: DataFrame, run: str, by: tuple[str, ...] = ("workload", "name")) -> DataFrame:
    """Best value of each metric per workload, and the run that had it (the first in a tie)."""
    best = F.min(F.struct(_score().alias("score"), F.col("value"), F.col(run)))
    return (
        metrics.where(F.col("value").isNotNull())
        .groupBy(*by).agg(best.alias("b")).select(*by, f"b.{run}", "b.value")
    )


def rank_runs(metrics: DataFrame, run: str, by: tuple[str, ...] = ("workload", "name")) -> DataFrame:
    """Rank of each run within its workload and metric, best first, ties sharing a rank.

    A window over the whole group would put a hot workload into one task. Instead the rows
    are range-partitioned by group, score and run, which cuts a large group into slices;
    rows are ranked inside their slice and the slices are then offset by what precedes them.
    `metrics` is read twice, so pass a stored table, not a costly query. NULL is a group
    like any other; rows without a value are kept, with a NULL rank.
    """
    by = list(by)
    unranked = metrics.where(F.col("value").isNull()).select("*", F.lit(None).cast("long").alias("rank"))
    slice_key = ["slice", *by]
    sliced = (
        metrics.where(F.col("value").isNotNull()).withColumn("score", _score())
        .repartitionByRange(*by, "score", run).withColumn("slice", F.spark_partition_id())
    )
    in_slice = Window.partitionBy(*slice_key).orderBy("score")
    # Written once: the slice bounds are sampled, so both uses must see the same evaluation.
    local = cut(sliced.withColumn("local_rank", F.rank().over(in_slice)), "ranks")

    # One row per slice and group.
    slices = local.groupBy(*slice_key).agg(
        F.count("*").alias("n"), F.min("score").alias("lo"),
        F.max("score").alias("hi"), F.max("local_rank").alias("hi_rank"),
    )
    order = Window.partitionBy(*by).orderBy("slice")
    same_hi = Window.partitionBy(*by, "hi").orderBy("slice")
    offsets = (
        slices
        .withColumn("before", F.coalesce(
            F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        # A tie may run over several slices: its rank is the one where it began.
        .withColumn("hi_rank", F.min(F.col("before") + F.col("hi_rank")).over(same_hi))
        .select(
            *slice_key, "before",
            F.when(F.lag("hi").over(order) == F.col("lo"), F.lag("hi_rank").over(order)).alias("tie_rank"),
            F.col("lo"),
        )
    )
    rank = F.when(
        F.col("tie_rank").isNotNull() & (F.col("score") == F.col("lo")), F.col("tie_rank")
    ).otherwise(F.col("before") + F.col("local_rank"))
    offsets = offsets.select(*[F.col(c).alias(f"of_{c}") for c in slice_key], "before", "tie_rank", "lo")
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in slice_key])
    return local.join(offsets, same).select(*metrics.columns, rank.cast("long").alias("rank")).union(unranked)
