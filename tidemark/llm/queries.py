"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints, mixing, ngram_join, packing, pii, quality, substrings, suffix_index, toxicity, urls
from tidemark.llm.common import read


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents", "doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.digest(read(spark, sf_dir, "pages", "page_id", "url"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_index.digest(read(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_pii, op3_quality_rules, op4_best_fit_packing, op5_substring_dedup, op6_url_filters, op7_toxicity, op8_ngram_jaccard_join, op9_document_fingerprints, op10_suffix_array_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.sql(), "op5_substring_dedup": substrings.sql(), "op6_url_filters": urls.sql()}
