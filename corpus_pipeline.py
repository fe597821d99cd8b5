"""A corpus from raw documents to packed sequences: the STAGES in order, each on all that the one before it kept.

Edge cases, for each stage: columns other than those of documents are dropped, whatever their names; an empty table gives no rows; null doc_ids
and sources stay null. Null, blank and short texts go in the first stage; of equal rows one stays in the second; very long texts are
handled whole, in memory proportional to one of them, and cut into pieces by the last stage alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import mixing, ngram_join, packing, pii, quality
from tidemark.llm.common import stored

#: Columns of documents; all stages but the last return them.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, then documents that fail."""
    return quality.cleaned(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id."""
    return ngram_join.one_of_each(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    return pii.redact_texts(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Small sources are passed over up to twice, so that weights are flatter; no document is dropped."""
    return mixing.mixed_documents(docs.select(*COLUMNS), max_repetition=2.0, budget_share=None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.packed(docs.select("doc_id", "text"))


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii", personal_data),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisation can't be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents under sf_dir; each stage's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
