"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from minekit.llm import (
    html_text,
    language,
    licenses,
    line_rules,
    negatives,
    packing,
    quality,
    runs,
    secret_scan,
    segmentation,
    simhash,
    token_counts,
    winnow,
)
from minekit.llm.common import documents
from minekit.operators.scale import scratch_path


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-cache")
    return token_counts.digest_columns(token_counts.count_tokens(documents(spark, sf_dir), cache))


def op2_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.n_best(documents(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest_columns(secret_scan.find_secrets(documents(spark, sf_dir)))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.classify(docs, model)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), with_ids=False)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest_columns(simhash.near_duplicates(documents(spark, sf_dir)))


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.digest_columns(winnow.edited_pairs(documents(spark, sf_dir)))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest_columns(licenses.scan_licenses(documents(spark, sf_dir)))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.clean_lines(documents(spark, sf_dir), texts=False)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest_columns(runs.find_runs(documents(spark, sf_dir), edit=runs.planted))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.digest_columns(html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = negatives.moved_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return negatives.mine(negatives.whole_vectors(vectors))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_token_counts,
        op2_n_best,
        op3_secrets,
        op4_quality,
        op5_language,
        op6_packing,
        op7_simhash,
        op8_winnowing,
        op9_licenses,
        op10_line_rules,
        op11_runs,
        op12_main_text,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {}
