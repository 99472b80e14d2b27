"""Training-data pipeline over `documents`: each stage takes what its predecessor kept.

A stage is a function (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents. Nulls, empty
texts, repeated rows and empty tables have the results that each operator's docstring states: texts that are null, empty or
without a letter are rejected by the first stage, rows without doc_id stay unless they are copies, and an empty table gives
an empty one. Further columns of any name, also of one that an operator uses, come through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from accordant.llm.common import table
from accordant.sources.stage import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are rejected by every language's centroids."""
    return language_id.keep_known(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the largest doc_id of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each class of near duplicates."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left."""
    return bpe.encode_documents(docs).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs


#: Near-duplicate classes and language centroids have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None
