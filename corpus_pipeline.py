"""From raw documents to packed training sequences, stage by stage.

Every stage reads what its predecessor wrote; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from promptlens.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from promptlens.llm.common import written


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a letter or in none of them go.

    The filters learn from the rows of ``docs`` itself that have a text and a language; where
    there are none, only documents without a letter go.
    """
    return language_id.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of texts that differ in white space only."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose sets of five-word shingles are similar by 0.8 or more."""
    return jaccard_join.drop_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often (0, 1 or 2 times) as the mix takes it; documents without words are not taken.

    Rows that repeat both id and text (or lack an id and repeat the text) are taken together.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("language id", keep_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]

# Language filters and the tokenizer are beyond SQL; a test holds the whole run against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
