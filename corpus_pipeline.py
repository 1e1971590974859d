"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, personal data, tokens.

Each stage gets all rows that the one before kept, with the columns of documents; the last returns what encoding gives for each document.
Nulls, empty and very long texts, equal rows, extra columns and empty tables go through as the operators' modules say. Rows of equal doc_id
and equal text count as copies of one document: near-duplicate removal leaves one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, catalog, decontaminate, near_dedup, pii, quality
from tessera.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, similarity 0.8: of each component the row with the smallest doc_id."""
    return near_dedup.clean(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of any benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by the names of their kinds."""
    return pii.redact(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    return bpe.encode(docs, catalog.vocabulary("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", one_of_each_group), ("decontamination", without_benchmark), ("personal data", without_personal_data), ("encoding", encoded)]

#: Learned rules, components of similarities and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
