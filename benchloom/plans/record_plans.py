"""Run records, on events rendered as report lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from benchloom.functions import columns as X
from benchloom.operators import records
from benchloom.plans.registry import Registry
from benchloom.sources.logs import read_app_list, read_logs, write_raw_records
from benchloom.sources.report import parse_report, read_report
from benchloom.sources.runs import read_runs, write_runs
from benchloom.sources.tables import app_list, jobs, load, report_lines
from benchloom.storage import cut, new_path

registry = Registry()
query = registry.query


def _runs(spark, d):
    """Parsed report with the ids that the lines carry in fields 12 and 13."""
    return parse_report(report_lines(load(spark, d, "events"))).withColumns(
        {"run": F.col("f12").cast("long"), "user_id": F.col("f13").cast("long")}
    )


def _apps(spark, d):
    return app_list(load(spark, d, "events"))


# The records as SQL sees them.
_R = """
    r AS (
        SELECT *, size_mb / duration_s AS throughput FROM (
            SELECT event_id AS run, user_id, event_type AS workload, date_trunc('second', ts) AS record_ts,
                   value + 0.01::DOUBLE AS duration_s,
                   json_extract_string(props, '$.k')::DOUBLE AS size_mb
            FROM events)),
    apps AS (SELECT DISTINCT event_type || '/bin/run.sh' AS value FROM events WHERE event_type <> 'click')
"""
_METRICS = """
    m AS (
        SELECT run, workload, 'duration' AS name, duration_s AS value, 'secs' AS units, 'asc' AS direction FROM r
        UNION ALL
        SELECT run, workload, 'throughput', throughput, 'x/sec', 'desc' FROM r)
"""


@query(f"""
    WITH {_R} SELECT run, workload, record_ts, round(duration_s, 6) AS duration_s, size_mb,
    round(throughput, 6) AS throughput, workload || '-Config' AS config FROM r
""")
def read_report_file(spark, d):
    """Lines written to a text file and scanned back."""
    path = new_path(spark, "report")
    report_lines(load(spark, d, "events")).write.text(path)
    return read_report(spark, path).select(
        F.col("f12").cast("long").alias("run"), "workload", "record_ts",
        F.round("duration_s", 6).alias("duration_s"), "size_mb",
        F.round("throughput", 6).alias("throughput"), "config",
    )


@query(f"WITH {_R} SELECT run, workload, record_ts FROM r WHERE contains(workload || '-Config', 'or-Conf')")
def records_with_key(spark, d):
    """The key is part of another field than the workload."""
    return records.records_for(_runs(spark, d), "or-Conf").select("run", "workload", "record_ts")


@query(f"WITH {_R} SELECT run, workload, record_ts FROM r WHERE workload = 'view'")
def records_of_workload(spark, d):
    return records.records_for(_runs(spark, d), "view", exact=True).select("run", "workload", "record_ts")


@query(f"""
    WITH {_R} SELECT run, workload, record_ts, round(duration_s, 6) AS duration_s,
    round(throughput, 6) AS throughput FROM r
""")
def run_metrics(spark, d):
    return records.run_metrics(_runs(spark, d), "run").withColumns(
        {c: F.round(c, 6) for c in ("duration_s", "throughput")}
    )


_LATEST = "SELECT run, workload, record_ts, round(duration_s, 6) AS duration_s FROM r"


@query(f"WITH {_R} {_LATEST} QUALIFY row_number() OVER (PARTITION BY workload ORDER BY record_ts DESC, run DESC) = 1")
def latest_per_workload(spark, d):
    return records.latest_per_key(_runs(spark, d), "workload", ["record_ts", "run"]).select(
        "run", "workload", "record_ts", F.round("duration_s", 6).alias("duration_s")
    )


@query(f"WITH {_R} {_LATEST} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY record_ts DESC, run DESC) = 1")
def latest_per_user(spark, d):
    return records.latest_per_key(_runs(spark, d), "user_id", ["record_ts", "run"]).select(
        "run", "workload", "record_ts", F.round("duration_s", 6).alias("duration_s")
    )


@query(f"WITH {_R} {_LATEST} WHERE contains(workload || '-Config', 'chase-Conf') ORDER BY record_ts DESC, run DESC LIMIT 1")
def latest_record(spark, d):
    return records.latest(_runs(spark, d), "chase-Conf", ["record_ts", "run"]).select(
        "run", "workload", "record_ts", F.round("duration_s", 6).alias("duration_s")
    )


_CATALOG = ", ".join(str(row) for row in records.CATALOG)
_ACTIONS = [row[0] for row in records.CATALOG] + ["sparkpi"]


@query(f"""
    WITH {_R}, c(action, benchmark, result_key) AS (VALUES {_CATALOG})
    SELECT run, action, benchmark, result_key
    FROM (SELECT run, ({_ACTIONS})[1 + run % {len(_ACTIONS)}] AS action FROM r) JOIN c USING (action)
""")
def catalog_lookup(spark, d):
    """Runs spread over the eight actions of the catalog and one it does not have."""
    actions = F.array(*[F.lit(a) for a in _ACTIONS])
    runs = _runs(spark, d).select("run", actions[(F.col("run") % len(_ACTIONS)).cast("int")].alias("action"))
    return records.with_catalog(runs, records.catalog(spark)).select("run", "action", "benchmark", "result_key")


@query(f"WITH {_R} SELECT run, workload FROM r WHERE EXISTS (FROM apps WHERE starts_with(apps.value, workload))")
def valid_runs(spark, d):
    return records.valid_runs(_runs(spark, d).select("run", "workload"), _apps(spark, d))


@query(f"WITH {_R} SELECT run, workload FROM r WHERE NOT EXISTS (FROM apps WHERE starts_with(apps.value, workload))")
def invalid_runs(spark, d):
    return records.invalid_runs(_runs(spark, d).select("run", "workload"), _apps(spark, d))


@query(f"WITH {_R} SELECT value FROM apps")
def read_apps(spark, d):
    path = new_path(spark, "apps")
    _apps(spark, d).write.text(path)
    return read_app_list(spark, path)


@query(f"WITH {_R} SELECT value FROM apps WHERE value LIKE 'sign%'")
def known_apps(spark, d):
    return records.known_apps(_apps(spark, d), "sign")


@query(f"""
    WITH {_R}, names AS (SELECT DISTINCT event_type AS benchmark FROM events)
    SELECT benchmark, (SELECT count(*) FROM apps WHERE starts_with(value, benchmark)) AS n_apps FROM names
""")
def app_counts(spark, d):
    names = load(spark, d, "events").select(F.col("event_type").alias("benchmark")).distinct()
    return records.app_counts(_apps(spark, d), names)


@query(f"WITH {_R}, {_METRICS} SELECT run, workload, name, round(value, 6) AS value, units, direction FROM m")
def metrics_long(spark, d):
    return records.unpivot_metrics(_runs(spark, d), "run", "workload").withColumn("value", F.round("value", 6))


@query(f"WITH {_R} SELECT run, workload, round(duration_s, 6) AS score, 'secs' AS units, 'asc' AS direction FROM r WHERE duration_s IS NOT NULL")
def composite_scores(spark, d):
    metrics = records.unpivot_metrics(_runs(spark, d), "run", "workload")
    return records.composite(metrics, "run", "workload").withColumn("score", F.round("score", 6))


@query(f"""
    WITH {_R} SELECT workload AS benchmark, strftime(record_ts, '%Y-%m-%d 00:00') AS run,
    count(*) AS n_records, round(sum(duration_s), 4) AS duration_s FROM r GROUP BY ALL
""")
def raw_records(spark, d):
    """Raw lines kept as logs, those of a workload and day as one, scanned back and parsed again."""
    path = new_path(spark, "raw")
    daily = F.date_format("record_ts", "yyyy-MM-dd 00:00")
    write_raw_records(_runs(spark, d).withColumn("run", daily), path)
    seconds = F.sum(X.field(F.col("value"), 3).cast("double"))
    return read_logs(spark, path).groupBy("benchmark", "run").agg(
        F.count("*").alias("n_records"), F.round(seconds, 4).alias("duration_s"),
    )


@query(f"""
    WITH {_R}, {_METRICS}
    SELECT workload, name, run, round(value, 6) AS value FROM m
    QUALIFY row_number() OVER (
        PARTITION BY workload, name ORDER BY CASE direction WHEN 'asc' THEN value ELSE -value END, run) = 1
""")
def best_run(spark, d):
    metrics = records.unpivot_metrics(_runs(spark, d), "run", "workload")
    return records.best_run(metrics, "run").withColumn("value", F.round("value", 6))


@query(f"""
    WITH {_R}, {_METRICS}
    SELECT run, workload, name, rank() OVER (
        PARTITION BY workload, name ORDER BY CASE direction WHEN 'asc' THEN value ELSE -value END) AS rank
    FROM m
""")
def rank_runs(spark, d):
    """On stored metrics: the range partitioning reads its input twice, once for the bounds."""
    metrics = cut(records.unpivot_metrics(_runs(spark, d), "run", "workload"), "metrics")
    return records.rank_runs(metrics, "run").select("run", "workload", "name", "rank")


@query(f"WITH {_R} SELECT run, workload, record_ts, round(duration_s, 6) AS duration_s FROM r")
def stored_runs(spark, d):
    """Runs written below their workload and read back."""
    path = new_path(spark, "runs")
    write_runs(_runs(spark, d).select("run", "workload", "record_ts", "duration_s", "raw"), path)
    return read_runs(spark, path).select("run", "workload", "record_ts", F.round("duration_s", 6).alias("duration_s"))


@query(f"WITH {_R} SELECT run, workload, workload || '-Config' AS config, '' AS beyond FROM r")
def line_fields(spark, d):
    line = F.col("value")
    return report_lines(load(spark, d, "events")).select(
        X.field(line, 12).cast("long").alias("run"), X.field(line, 1).alias("workload"),
        X.field(line, 7).alias("config"), X.field(line, 19).alias("beyond"),
    )


@query("SELECT event_id, strptime(strftime(ts, '%Y-%m-%d-%H:%M:%S'), '%Y-%m-%d-%H:%M:%S') AS record_ts FROM events")
def record_times(spark, d):
    lines = report_lines(load(spark, d, "events"))
    return lines.select(
        X.field(F.col("value"), 12).cast("long").alias("event_id"),
        X.record_time(X.field(F.col("value"), 2)).alias("record_ts"),
    )


_ENDS = "ends AS (SELECT l_orderkey, max(l_shipdate) AS end_ts FROM lineitem GROUP BY 1)"


@query(f"""
    WITH {_ENDS} SELECT o_orderkey, (epoch(date_trunc('second', end_ts)) - epoch(date_trunc('second', o_orderdate)))::BIGINT
    AS duration_s FROM orders JOIN ends ON o_orderkey = l_orderkey
""")
def run_durations(spark, d):
    starts, ends = jobs(load(spark, d, "orders"), load(spark, d, "lineitem"))
    return starts.join(ends, "job_id").select(
        F.col("job_id").alias("o_orderkey"), X.duration_s(F.col("start_ts"), F.col("end_ts")).alias("duration_s")
    )


@query(f"""
    WITH {_ENDS} SELECT o_orderkey, o_custkey % 97 AS queue_wait_s,
    (epoch(date_trunc('second', end_ts)) - epoch(date_trunc('second', o_orderdate)))::BIGINT - o_custkey % 97 AS run_time_s
    FROM orders JOIN ends ON o_orderkey = l_orderkey
""")
def action_timing(spark, d):
    """Order dates, delayed by some seconds, and last shipments as the time texts of actions."""
    orders = load(spark, d, "orders")
    starts, ends = jobs(orders, load(spark, d, "lineitem"))
    waits = orders.select(F.col("o_orderkey").alias("job_id"), (F.col("o_custkey") % 97).alias("wait"))

    def as_text(ts):
        return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 UTC"))

    started = F.col("start_ts") + F.make_dt_interval(secs=F.col("wait"))
    timing = F.struct(
        X.action_time(as_text(F.col("start_ts"))).alias("enqueued"),
        X.action_time(as_text(started)).alias("started"),
        X.action_time(as_text(F.col("end_ts"))).alias("completed"),
    )
    return starts.join(ends, "job_id").join(waits, "job_id").withColumn("t", timing).select(
        F.col("job_id").alias("o_orderkey"),
        X.queue_wait_s(F.col("t")).alias("queue_wait_s"), X.run_time_s(F.col("t")).alias("run_time_s"),
    )


@query("""
    SELECT event_id, round(json_extract_string(props, '$.k')::DOUBLE / nullif(value, 0), 6) AS throughput FROM events
""")
def run_throughput(spark, d):
    size = F.get_json_object("props", "$.k").cast("double")
    return load(spark, d, "events").select(
        "event_id", F.round(X.throughput(size, F.col("value")), 6).alias("throughput")
    )


@query("SELECT l_orderkey, l_linenumber, make_timestamp((1450000000 + l_partkey) * 1000000) AS run_time FROM lineitem")
def run_times(spark, d):
    """Epoch run ids made from part keys."""
    run_id = F.lit(1_450_000_000) + F.col("l_partkey")
    return load(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", X.run_time(run_id).cast("timestamp_ntz").alias("run_time")
    )
