"""Workload input tables and frames derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def report_lines(events: DataFrame) -> DataFrame:
    """Events rendered as 18-field report lines: size from the props, event id in field 12."""
    duration = F.col("value") + F.lit(0.01)
    size = F.get_json_object("props", "$.k").cast("double")
    fields = [
        F.col("event_type"),
        F.date_format("ts", "yyyy-MM-dd-HH:mm:ss"),
        duration.cast("string"),
        size.cast("string"),
        (size / duration).cast("string"),
        F.lit("0"),
        F.concat(F.col("event_type"), F.lit("-Config")),
        *[F.lit("")] * 4,
        F.col("event_id").cast("string"),
        F.col("user_id").cast("string"),
        *[F.lit("")] * 5,
    ]
    return events.select(F.array_join(F.array(*fields), ",", "").alias("value"))


def app_list(events: DataFrame) -> DataFrame:
    """Distinct event types but one, as an application list with a line suffix to match past."""
    return (
        events.select("event_type").distinct()
        .where(F.col("event_type") != "click")
        .select(F.concat("event_type", F.lit("/bin/run.sh")).alias("value"))
    )


def log_lines(documents: DataFrame) -> DataFrame:
    """Document texts as job logs: one row per line, the document id as run id."""
    return documents.select(
        F.col("doc_id").alias("run"), F.explode(F.split("text", "\n")).alias("value")
    )


def jobs(orders: DataFrame, lineitem: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orders as job starts and their last shipment as job end."""
    starts = orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("start_ts"))
    ends = lineitem.groupBy(F.col("l_orderkey").alias("job_id")).agg(F.max("l_shipdate").alias("end_ts"))
    return starts, ends


def trade_edges(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Directed graph of customers, parts and suppliers: customer->part->supplier->customer.

    Every line item gives three edges, so the edge count is linear in the rows whatever the
    size of one order; pairing the parts of an order would be quadratic in it. Vertex ids are
    3 * key + {0 customer, 1 part, 2 supplier}.
    """
    customer = F.col("o_custkey") * 3
    part = F.col("l_partkey") * 3 + 1
    supplier = F.col("l_suppkey") * 3 + 2
    hops = F.array(*[
        F.struct(a.alias("src"), b.alias("dst"))
        for a, b in ((customer, part), (part, supplier), (supplier, customer))
    ])
    return (
        lineitem.select("l_orderkey", "l_partkey", "l_suppkey")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.inline(hops)).distinct()
    )


def ratings(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Quantity a customer bought of a part, as the rating of an item by a user."""
    return (
        lineitem.select("l_orderkey", "l_partkey", "l_quantity")
        .join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"))
        .agg(F.sum("l_quantity").alias("rating"))
    )


def points(lineitem: DataFrame) -> DataFrame:
    """Line items spread over the unit square by modular hashes of their keys."""
    return lineitem.select(
        ((F.col("l_orderkey") * 7919 + F.col("l_linenumber")) % 10007 / F.lit(10007.0)).alias("x"),
        ((F.col("l_partkey") * 104729 + F.col("l_suppkey")) % 10009 / F.lit(10009.0)).alias("y"),
    )


def labelled_text(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.select("doc_id", "text").join(labels, "doc_id").select(
        "doc_id", "text", F.col("quality").cast("double").alias("label")
    )


def text_form(documents: DataFrame) -> DataFrame:
    """Length of each text on a logarithmic scale, and the share of spaces in it; a NULL text is empty."""
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    gaps = size - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return documents.select("doc_id", F.log(1.0 + size).alias("size"), (gaps / (1.0 + size)).alias("gaps"))
