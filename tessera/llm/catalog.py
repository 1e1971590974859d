"""The registered queries of this subpackage, over whole tables with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, html_text, near_dedup, pii, quality, secrets, token_shards, urls, warc
from tessera.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pii_semi_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_near_dedup_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"))


def op6_quality_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_bpe_prefix_dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_html_consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_url_temporal_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judged(urls.dated_captures(pages), urls.stand_in_list(pages))


def op9_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_shards.report(table(spark, sf_dir, "documents"), token_shards.Vocabulary(vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii_semi_markov, op2_benchmark_decontamination, op3_html_consensus_paths, op4_near_dedup_odd_sketch, op5_secret_ownership,
        op6_quality_decision_list, op7_bpe_prefix_dp, op8_url_temporal_lists, op9_warc_seekable, op10_training_order,
    )
}
ORACLES: dict[str, str] = {"op8_url_temporal_lists": urls.ORACLE, "op9_warc_seekable": warc.ORACLE}
