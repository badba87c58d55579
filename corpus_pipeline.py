"""Corpus pipeline over ``documents``: quality, exact copies, near copies,
benchmark leaks, packing. Each stage is written as Parquet and read again as
the next one's input; all but the last return the columns of ``documents``.

No stage is plain SQL (trained weights, sampled scores, alignments, packing
search), so ``ORACLE_SQL`` is None and tests hold the stages against
brute-force versions.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from shardwright.llm import decontaminate, exact_dedup, jaccard_join, packing_ga, quality
from shardwright.llm.queries import tokenizer_files
from shardwright.session import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.drop_near(docs, n_words=5, num=80, den=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing_ga.pack(docs, **tokenizer_files())


STAGES = [
    ("quality_filter", quality_filter),
    ("drop_exact_copies", drop_exact_copies),
    ("drop_near_copies", drop_near_copies),
    ("drop_benchmark_leaks", drop_benchmark_leaks),
    ("pack_sequences", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: one per packed piece."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
