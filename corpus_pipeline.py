"""From raw documents to packed training sequences: five stages, each written before the next reads it."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from wavelead.llm.host_rules import kept_documents
from wavelead.llm.near_dup import distinct_documents
from wavelead.llm.packing import pack_documents
from wavelead.llm.passages import passages, without_passages
from wavelead.llm.quality import accepted_documents
from wavelead.llm.queries import table, vocabulary
from wavelead.storage import settle


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside its held-out fold."""
    return accepted_documents(docs, table(spark, sf_dir, "labels"), "quality")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules go, and those of hosts that mostly fail."""
    return kept_documents(docs, host="source")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return distinct_documents(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out of the later ones."""
    return without_passages(docs, settle(spark, "passages", lambda: passages(docs)))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return pack_documents(docs, vocabulary(), end=2)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", packing),
]

# A trained classifier and fuzzy passages are not for SQL; the tests check every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage writes on its way is removed once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(spark, name.replace(" ", "-"), partial(stage, spark, docs, sf_dir))
    return docs
