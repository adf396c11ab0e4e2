"""Queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storelens.llm import chat, decontam, mixing, ngram_join, packing, passages, quality, secrets, urls, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op2_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.archived(table(spark, sf_dir, "pages"))
    return made.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op1_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op9_quality_cascade": op9_quality_cascade,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op6_repeated_passages": op6_repeated_passages,
    "op8_benchmark_leaks": op8_benchmark_leaks,
    "op5_pivotal_mix": op5_pivotal_mix,
    "op7_token_ids": op7_token_ids,
    "op2_warc_chunks": op2_warc_chunks,
    "op3_url_verdicts": op3_url_verdicts,
    "op4_secret_spans": op4_secret_spans,
    "op1_chat_repair": op1_chat_repair,
}

SQL: dict[str, str] = {
    "op9_quality_cascade": quality.SQL,
    "op10_ngram_jaccard": ngram_join.SQL,
    "op6_repeated_passages": passages.SQL,
    "op2_warc_chunks": warc.SQL,
}
