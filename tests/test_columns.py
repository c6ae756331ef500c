from datetime import datetime

from pyspark.sql import functions as F

from benchloom.functions import columns as X

LINE = "PageRank,2015-12-10-23:41:57,77.939000,71.888079,.922363,0,PageRank-MLlibConfig,,,,,10,12,,200000,4.0,1.3,0.15"


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()


def test_field_counts_from_one_and_is_empty_beyond_the_line(spark):
    line = F.lit(LINE)
    assert tuple(one(spark, *[X.field(line, n) for n in (1, 3, 5, 8, 18, 19)])) == (
        "PageRank", "77.939000", ".922363", "", "0.15", "")


def test_record_time(spark):
    good, bad = one(spark, X.record_time(F.lit("2015-12-10-23:41:57")), X.record_time(F.lit("2015-12-10")))
    assert good == datetime(2015, 12, 10, 23, 41, 57) and bad is None


def test_published_run_times(spark):
    mark = X.duration_s(X.mark_time(F.lit("2015-12-10T23:41:34Z")), X.mark_time(F.lit("2015-12-10T23:43:16Z")))
    timing = F.struct(
        X.action_time(F.lit("2015-12-10 23:42:10 +0000 UTC")).alias("enqueued"),
        X.action_time(F.lit("2015-12-10 23:42:15 +0000 UTC")).alias("started"),
        X.action_time(F.lit("2015-12-10 23:43:59 +0000 UTC")).alias("completed"),
    )
    assert tuple(one(spark, mark, X.queue_wait_s(timing), X.run_time_s(timing))) == (102, 5, 104)


def test_duration_cuts_both_ends_to_seconds(spark):
    start, stop = F.lit("2020-01-01 00:00:00.9").cast("timestamp"), F.lit("2020-01-01 00:00:02.1").cast("timestamp")
    assert one(spark, X.duration_s(start, stop))[0] == 2


def test_throughput_of_the_published_record(spark):
    value, none = one(spark, X.throughput(F.lit(71.888079), F.lit(77.939)), X.throughput(F.lit(1.0), F.lit(0.0)))
    assert round(value, 6) == 0.922363 and none is None


def test_run_time_from_epoch(spark):
    assert one(spark, X.run_time(F.lit(1449790894)).cast("string"))[0] == "2015-12-10 23:41:34"


def test_uniform_is_repeatable_and_even(spark):
    draws = spark.range(20_000, numPartitions=7).select(X.uniform(1, F.col("id")).alias("u"))
    row = draws.agg(F.avg("u"), F.stddev("u"), F.min("u"), F.max("u")).first()
    assert abs(row[0] - 0.5) < 0.01 and abs(row[1] - 12**-0.5) < 0.01 and 0 < row[2] and row[3] < 1
    again = spark.range(20_000, numPartitions=3).select(X.uniform(1, F.col("id")).alias("u"))
    assert draws.exceptAll(again).isEmpty()
