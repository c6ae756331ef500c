"""The SQL workload: select, aggregate and join over orders and line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def sql_select(orders: DataFrame, min_price: float) -> DataFrame:
    """Filtered scan: orders above a price."""
    return orders.where(F.col("o_totalprice") > min_price).select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"
    )


def sql_aggregate(lineitem: DataFrame, *keys: str) -> DataFrame:
    """Totals of line items per key."""
    return lineitem.groupBy(*keys).agg(
        F.count("*").alias("n_items"),
        F.sum("l_quantity").alias("sum_qty"),
        F.sum(revenue()).alias("revenue"),
        F.avg("l_discount").alias("avg_discount"),
    )


def sql_join(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Each order with its items."""
    return orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey"))


def revenue_by_priority(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return sql_join(orders, lineitem).groupBy("o_orderpriority").agg(
        F.count("*").alias("n_items"), F.sum(revenue()).alias("revenue")
    )
