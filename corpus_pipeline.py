"""Corpus pipeline: quality filter, near-dedup, mixing and tokenisation of ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept; its
rows are written as Parquet and read again as the next stage's ``docs``.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from barwise.llm import lexicon, mixing, quality, simhash  # noqa: E402
from barwise.llm.common import prepare, table, tokenizer_bytes, written  # noqa: E402


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking accepts (score of 0.5 or more)."""
    prepare(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(spark, docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of SimHash near-duplicates, the one with the least doc_id."""
    prepare(spark)
    return simhash.keep_one(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    prepare(spark)
    return mixing.mixed(spark, docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, ids."""
    import public_tokenizers
    prepare(spark)
    return lexicon.encode(spark, docs, tokenizer_bytes(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality", quality_filter), ("simhash", near_dedup), ("mixing", mix_sources), ("bpe", tokenize)]

#: Training, connected components and tokenisation are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a row for each document of the mix (copies repeated):
    doc_id, n_tokens, ids."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "n_tokens", F.col("ids"))
