"""From raw documents to a training mix: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from benchloom.llm import decontaminate, mixing, near, suffixes, toxicity
from benchloom.llm.frames import held_out
from benchloom.llm.workers import importable
from benchloom.sources.tables import load
from benchloom.storage import cut


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject, learnt from those that are not held out."""
    importable(spark)
    model = toxicity.fit(docs.where(~held_out()).select("doc_id", "text"), load(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    importable(spark)
    return near.one_of_each(docs, common=None)


def cut_repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 400-byte strings that occur elsewhere; `n_chars` is that of the text left."""
    importable(spark)
    cleaned = suffixes.without_repeats(docs.withColumnRenamed("n_chars", "was_chars"))
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("was_chars"))).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark items make less than a twentieth."""
    importable(spark)
    return decontaminate.clean_documents(docs, load(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    importable(spark)
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_bytes),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# Trained scores and floating-point duals are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
