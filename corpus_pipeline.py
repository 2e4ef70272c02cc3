"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leaksieve.llm import exact_dedup, ngram_join, packing, pii, quality
from leaksieve.llm.common import column, stage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_copies(docs).select(*map(column, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similarity join, the one with the smallest id stays."""
    return ngram_join.keep_one_of_each(docs).select(*map(column, docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind's name."""
    return pii.redact(docs).select(*map(column, docs.columns))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


#: Row groups and pages of what is staged: texts' buffers stay small, as executors have little memory beside what they hold.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(128 << 10)}

STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("personal data", personal_data),
    ("packing", packed_sequences),
]
#: Shingle sets, Luhn sums inside texts and a tokenizer's ids together are past SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"), **SMALL_GROUPS)
    return docs
