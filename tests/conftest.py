from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from benchloom.operators import skew  # noqa: E402
from benchloom.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def event_logs(tmp_path_factory):
    return tmp_path_factory.mktemp("event-log")


@pytest.fixture(scope="session")
def spark(event_logs):
    return local_session(
        8, app="tests", spark__sql__shuffle__partitions="4", spark__eventLog__enabled="true",
        spark__eventLog__dir=f"file:{event_logs}", spark__eventLog__compress="false",
        spark__eventLog__rolling__enabled="false",
    )


@pytest.fixture(params=["broadcast", "shuffle"])
def lookup_size(request, monkeypatch):
    """Run a test with lookups below and above broadcast size."""
    if request.param == "shuffle":
        monkeypatch.setattr(skew, "BROADCAST_ROWS", -1)
    return request.param


@pytest.fixture()
def no_auto_broadcast(spark):
    """Keep Spark from broadcasting small tables by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()
