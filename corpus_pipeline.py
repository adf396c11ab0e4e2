"""Corpus pipeline: from raw documents to token-id files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's documents.  All stages take nulls in any column, empty and very long texts,
repeated rows, empty tables and further columns of any name; what each does with them is said below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import decontam, mixing, ngram_join, packing, quality
from storelens.llm.common import stored
from storelens.session import shipped


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; null and empty texts are too short and go."""
    return quality.cascade(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest id.

    Documents without an id or without words are copies of nothing and stay.
    """
    return ngram_join.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null texts have none."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source, a text without words goes."""
    return mixing.mixed(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the token-id files hold, a row for each document of the mix; null ids come first."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: Alignment, pivotal draws and the tokenizer can't be put in SQL; tests/llm holds brute-force checks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = shipped(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
