"""Training-data pipeline: each stage takes what its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pagegrain.llm import byte_bpe, decontaminate, language_id, ngram_join, substring_dedup


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject."""
    return language_id.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    return ngram_join.keep_one(docs)


def copied_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the passages that an earlier one holds."""
    return substring_dedup.remove_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids and digests of the ids and of the bytes decoded from them."""
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("ngram_join", near_duplicates),
    ("substring_dedup", copied_passages),
    ("decontamination", benchmark_leaks),
    ("byte_bpe", token_ids),
]
ORACLE_SQL = None  # a trained model decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's result is written and read again."""
    from pagegrain.llm.scratch import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialise(docs, name)
    return docs
