"""Corpus pipeline: stages that take ``documents`` to encoded training text.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm import bpe, exact_dedup, jaccard, mixing, quality
from emberlog.llm._shared import table, without_rows
from emberlog.storage import fresh_dir, scratch

RANKS = "byte_bpe_multi_50k.tiktoken"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; the rejected ones go."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id.

    Near copies share 80 of 100 distinct shingles of five words or more.
    Documents without words are near copies of nothing and stay.
    """
    found = jaccard.jaccard_components(docs, words=5, num=8, den=10)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("component_id").isNotNull())
    return without_rows(docs, gone.select(F.col("doc_id").alias("id"), "th"), "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: a document stands there as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def encode_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, with the hash of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_filter),
    ("exact dedup", drop_copies),
    ("n-gram jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("bpe encoding", encode_text),
]

# The classifier and the encoder have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again.

    Intermediates of a stage are deleted once it is written; the last stage has none.
    """
    docs = table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
