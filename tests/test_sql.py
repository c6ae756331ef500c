from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from benchloom.operators import sqlwork
from benchloom.sources import tables


@pytest.fixture()
def small_partitions(spark, no_auto_broadcast):
    """Thresholds at which AQE treats test data as it treats large data by default."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def order_rows(spark, n=2000):
    return spark.range(n).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 50).alias("o_custkey"), F.lit(10.0).alias("o_totalprice"),
        F.lit(None).cast("timestamp_ntz").alias("o_orderdate"), F.concat(F.lit("p"), F.col("id") % 5).alias("o_orderpriority"),
    )


def item_rows(spark, n=120_000, orders=2000):
    """Line items of which order 7 has a third."""
    return spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(orders))).alias("l_orderkey"),
        (F.col("id") % 100).alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"),
        F.lit(1.0).alias("l_quantity"), F.col("id").cast("double").alias("l_extendedprice"), F.lit(0.1).alias("l_discount"),
    )


def test_join_splits_a_hot_order(spark, small_partitions):
    orders, items = order_rows(spark), item_rows(spark)
    joined = sqlwork.sql_join(orders, items)
    assert len(joined.collect()) == 120_000
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.where("o_orderkey = 7").count() == items.where("l_orderkey = 7").count()


def test_revenue_by_priority_with_a_hot_order(spark, small_partitions):
    items = item_rows(spark)
    rows = sqlwork.revenue_by_priority(order_rows(spark), items).collect()
    assert sum(r.n_items for r in rows) == 120_000
    total = items.agg(F.sum(sqlwork.revenue())).first()[0]
    assert abs(sum(r.revenue for r in rows) / total - 1) < 1e-12


def test_select_and_aggregate(spark):
    rows = spark.createDataFrame(
        [("a", 2.0, 10.0, 0.5), ("a", 1.0, 20.0, 0.0), ("b", 5.0, 1.0, 0.0)],
        "k string, l_quantity double, l_extendedprice double, l_discount double")
    got = {r.k: (r.n_items, r.sum_qty, r.revenue, r.avg_discount) for r in sqlwork.sql_aggregate(rows, "k").collect()}
    assert got == {"a": (2, 3.0, 25.0, 0.25), "b": (1, 5.0, 1.0, 0.0)}
    assert sqlwork.sql_select(order_rows(spark, 10), 9.0).count() == 10
    assert sqlwork.sql_select(order_rows(spark, 10), 10.0).isEmpty()


def test_trade_edges_grow_with_items_not_with_order_size(spark):
    orders, items = order_rows(spark), item_rows(spark)
    edges = tables.trade_edges(orders, items)
    assert edges.count() <= 3 * 120_000 and edges.count() == edges.distinct().count()
    kinds = edges.select((F.col("src") % 3).alias("a"), (F.col("dst") % 3).alias("b")).distinct().collect()
    assert {tuple(r) for r in kinds} == {(0, 1), (1, 2), (2, 0)}


def test_ratings_are_unique_and_whole(spark):
    rows = tables.ratings(order_rows(spark), item_rows(spark))
    assert rows.select("user", "item").distinct().count() == rows.count()
    assert rows.agg(F.sum("rating")).first()[0] == 120_000
