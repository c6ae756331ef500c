"""Named queries over the table folder, with the SQL that gives the same result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Register a function under its own name."""

        def add(run: Query) -> Query:
            def in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
                spark.conf.set("spark.sql.session.timeZone", "UTC")
                return run(spark, sf_dir)

            self.queries[run.__name__] = in_utc
            if sql is not None:
                self.oracles[run.__name__] = sql
            return run

        return add

    def merge(self, *others: Registry) -> Registry:
        for other in others:
            self.queries |= other.queries
            self.oracles |= other.oracles
        return self
