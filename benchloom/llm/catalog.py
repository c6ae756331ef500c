"""All registered queries of the subpackage, and the pipeline at the top of the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from benchloom.llm import queries
from benchloom.llm.workers import importable
from benchloom.plans.registry import Query, Registry


def _shipped(run: Query) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return run(spark, sf_dir)

    return query


LLM = Registry()
LLM.queries = {name: _shipped(run) for name, run in queries.registry.queries.items()}
LLM.oracles = dict(queries.registry.oracles)


def _with_pipeline() -> None:
    import corpus_pipeline

    LLM.queries["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        LLM.oracles["pipeline"] = corpus_pipeline.ORACLE_SQL


_with_pipeline()
