"""Every registered query on the smallest tables, against its SQL where it has one."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from benchloom.plans.catalog import CORE
from check import compare, connect
from conftest import SF, plan_of


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, duck, name):
    # Plans in the event log carry the description of the query that they belong to.
    spark.sparkContext.setJobDescription(f"{'core' if name in CORE else 'other'}:{name}")
    try:
        got = queries()[name](spark, SF).toPandas()
    finally:
        spark.sparkContext.setJobDescription(None)
    assert len(got)
    if name in oracle_sql():
        assert compare(got, duck.execute(oracle_sql()[name]).df()) is None


def test_missing_values_compare_equal_in_columns_of_any_type():
    ours = pd.DataFrame({"a": [np.nan, np.nan], "b": ["x", None]})
    theirs = pd.DataFrame({"a": pd.array([None, None], dtype="Int64"), "b": ["x", np.nan]})
    assert compare(ours, theirs) is None
    assert compare(ours, theirs.assign(a=[1, None])) is not None
    assert compare(ours.assign(b=["x", "None"]), theirs) is not None


def test_entry(spark):
    assert entry(spark).columns == ["o_orderpriority", "n_items", "revenue"] and entry(spark).count() == 5


def test_oracles_belong_to_queries():
    assert set(oracle_sql()) <= set(queries())


def test_no_query_ran_a_nested_loop_or_python_rows(spark, event_logs):
    """Over the physical plans of all that this session has run so far; Python is judged in this catalog's queries."""
    plans, told = [], {}
    for log in event_logs.iterdir():
        for line in log.read_text().splitlines():
            if "physicalPlanDescription" in line:
                try:
                    event = json.loads(line)
                except json.JSONDecodeError:  # the line being written
                    continue
                run = (log.name, event["executionId"])
                told[run] = event.get("description", told.get(run, ""))
                plans.append((told[run], event["physicalPlanDescription"]))
    assert any(by.startswith("core:") for by, _ in plans)
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert not [by for by, p in plans if node in p], node
    # Products of whole blocks of factors are for numpy.
    blocks = ("core:recommended_items", "core:recommended_by_als")
    for node in ("EvalPython", "InPandas", "InArrow"):
        assert not [by for by, p in plans if node in p and by.startswith("core:") and by not in blocks], node


def scan_of(spark, name, marker="FileScan"):
    plan = plan_of(queries()[name](spark, SF)).split("== Physical Plan ==")[1]
    return [line for line in plan.splitlines() if marker in line]


def test_filters_and_columns_reach_the_scan(spark):
    (orders,) = scan_of(spark, "sql_select")
    assert "GreaterThan(o_totalprice,200000.0)" in orders and "o_orderpriority" not in orders.split("ReadSchema")[1]
    (lineitem,) = scan_of(spark, "sql_aggregate_by_part")
    schema = lineitem.split("ReadSchema")[1]
    assert "l_partkey" in schema and "l_shipdate" not in schema and "l_tax" not in schema


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("sql_aggregate_by_part", "revenue_by_priority", "check_logs", "graph_degrees", "tumbling_counts", "best_run"):
        plan = plan_of(queries()[name](spark, SF)).split("== Physical Plan ==")[1]
        assert "partial_" in plan[plan.index("Exchange"):], name
