"""The corpus pipeline: language, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs.  All stages but the last return the columns of ``documents``.  Models are learned from the tables in ``sf_dir``, never from
what a stage before has left over, so that a decision does not depend on the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from beaconloom.llm import language, near_duplicates, packing, toxicity
from beaconloom.llm.common import ship, table
from beaconloom.session import materialise

#: From this score on a document counts as toxic.
TOXIC = 0.5


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language: those with text in which there is a letter."""
    samples = language.labelled_sample(table(ship(spark), sf_dir, "documents"))
    if not samples:  # nothing to learn from: every document would be unknown
        return docs
    return docs.where(language.language_column(docs, samples) != language.UNKNOWN)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below ``TOXIC``."""
    model = toxicity.learn(table(ship(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))
    if not any(model.weights):  # no labels of both kinds: no document stands out
        return docs
    return docs.where(toxicity.score_column(docs, model) < TOXIC)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the one with the smallest doc_id."""
    ship(spark)
    return near_duplicates.keep_first(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("packing", packing_stage),
]

#: SQL can express none of the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
