"""Job logs and job history."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.operators import history, logs
from benchloom.plans.registry import Registry
from benchloom.sources import event_log
from benchloom.sources.logs import read_logs, write_logs
from benchloom.sources.tables import jobs, load, log_lines
from benchloom.storage import new_path

registry = Registry()
query = registry.query

# A dot in a log pattern stands for any character.
PATTERN = "[Tt]he .nd"


@query("""
    SELECT benchmark, run, count(*) AS n_lines, sum(length(value))::BIGINT AS n_chars
    FROM (SELECT 'b ' || lang AS benchmark, source AS run, unnest(string_split(text, chr(10))) AS value FROM documents)
    GROUP BY benchmark, run
""")
def read_log_files(spark, d):
    """Documents written as one log per source, below a folder of their language, and scanned back."""
    path = new_path(spark, "logs")
    documents = load(spark, d, "documents")
    benchmark = F.concat(F.lit("b "), "lang").alias("benchmark")
    write_logs(documents.select(benchmark, F.col("source").alias("run"), F.explode(F.split("text", "\n")).alias("value")), path)
    return read_logs(spark, path).groupBy("benchmark", "run").agg(
        F.count("*").alias("n_lines"), F.sum(F.length("value")).alias("n_chars")
    )


_LINES = "l AS (SELECT doc_id AS run, unnest(string_split(text, chr(10))) AS value FROM documents)"


@query(f"WITH {_LINES} SELECT run, bool_or(regexp_matches(value, '{PATTERN}')) AS ok FROM l GROUP BY run")
def check_logs(spark, d):
    return logs.check_logs(log_lines(load(spark, d, "documents")), PATTERN)


@query(f"""
    WITH {_LINES} SELECT run, value FROM l
    WHERE run NOT IN (SELECT run FROM l WHERE regexp_matches(value, '{PATTERN}'))
""")
def failed_lines(spark, d):
    return logs.failed_lines(log_lines(load(spark, d, "documents")), PATTERN)


_JOBS = """
    s AS (SELECT o_orderkey AS job_id, o_orderdate AS start_ts FROM orders),
    e AS (SELECT l_orderkey AS job_id, max(l_shipdate) AS end_ts FROM lineitem GROUP BY 1),
    h AS (
        SELECT s.job_id, start_ts, end_ts, CASE WHEN end_ts IS NULL THEN 'active' ELSE 'finished' END AS status,
               (epoch(end_ts) - epoch(start_ts))::DOUBLE AS duration_s
        FROM s LEFT JOIN e ON s.job_id = e.job_id)
"""


@query(f"WITH {_JOBS} SELECT * FROM h")
def job_history(spark, d):
    table = history.job_history(*jobs(load(spark, d, "orders"), load(spark, d, "lineitem")))
    return table.withColumn("duration_s", F.col("duration_s").cast("double"))


@query(f"WITH {_JOBS} SELECT job_id, start_ts FROM h WHERE status = 'active'")
def active_jobs(spark, d):
    return history.active_jobs(*jobs(load(spark, d, "orders"), load(spark, d, "lineitem")))


def write_event_log(starts, ends, path):
    """Stand-in for applications: (app_id, job_id, start_ts) and (app_id, job_id, end_ts, result) as log events."""
    started = starts.select(
        "app_id",
        F.to_json(F.struct(
            F.lit("SparkListenerJobStart").alias("Event"),
            F.col("job_id").alias("Job ID"),
            F.unix_millis(F.col("start_ts").cast("timestamp")).alias("Submission Time"),
        )).alias("value"),
    )
    ended = ends.select(
        "app_id",
        F.to_json(F.struct(
            F.lit("SparkListenerJobEnd").alias("Event"),
            F.col("job_id").alias("Job ID"),
            F.unix_millis(F.col("end_ts").cast("timestamp")).alias("Completion Time"),
            F.struct(F.col("result").alias("Result")).alias("Job Result"),
        )).alias("value"),
    )
    (
        started.unionByName(ended)
        .select(F.concat(F.lit("eventlog_v2_"), "app_id").alias("log"), "value")
        .hint("rebalance", "log")
        .write.partitionBy("log").mode("append").text(path)
    )


@query(f"""
    WITH {_JOBS} SELECT 'app-' || (job_id % 7) AS app_id, job_id, start_ts, end_ts, status, duration_s,
    CASE WHEN status = 'finished' THEN 'JobSucceeded' END AS result FROM h
""")
def event_log_history(spark, d):
    """Jobs written as event logs of seven applications, scanned back and joined."""
    path = new_path(spark, "event-log")
    starts, ends = jobs(load(spark, d, "orders"), load(spark, d, "lineitem"))
    app = F.concat(F.lit("app-"), (F.col("job_id") % 7).cast("string"))
    write_event_log(
        starts.withColumn("app_id", app),
        ends.withColumns({"app_id": app, "result": F.lit("JobSucceeded")}), path,
    )
    jobs_of = event_log.logged_jobs(event_log.read_event_log(spark, path)).drop("attempt")
    return jobs_of.withColumns({
        "start_ts": F.col("start_ts").cast("timestamp_ntz"), "end_ts": F.col("end_ts").cast("timestamp_ntz"),
        "duration_s": F.col("duration_s").cast("double"),
    })
