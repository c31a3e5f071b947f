"""Registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vakanz.llm import bpe, centroids, exact, html, leaks, licences, omh, quality, runs, secrets, shards, tokens, toxicity
from vakanz.llm.common import documents
from vakanz.llm.oracles import oracle_sql  # noqa: F401

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.licence_scan(documents(spark, sf_dir))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), VOCABULARY)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(documents(spark, sf_dir))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.near_classes(documents(spark, sf_dir))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir), VOCABULARY)


def op7_shuffle_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assign_shards(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leak_report(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(documents(spark, sf_dir, "pages"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_report(runs.with_planted_runs(documents(spark, sf_dir)))


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_report(documents(spark, sf_dir, "embeddings"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


_QUERIES = (
    op5_order_minhash,
    op9_benchmark_leaks,
    op2_licence_scan,
    op4_secret_scan,
    op1_line_quality,
    op10_main_text,
    op3_token_counts,
    op6_bpe_round_trip,
    op7_shuffle_shards,
    op8_exact_dedup,
    op11_periodic_runs,
    op12_heap_clusters,
    op13_toxicity,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in _QUERIES}
