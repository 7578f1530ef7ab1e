"""The corpus pipeline: five stages over ``documents``, each an operator of the training-data list.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept. All but the
last return the columns of ``documents``; the last returns the places of the pieces in the packed
sequences. Models are fitted on the stage's own input, without the held-out third of the ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.llm import language, near_copies, packing, quality, secret_scan
from minekit.llm.common import columns_of, documents, unused, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose score for label 1 is at least one half."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = unused(docs, "_score")
    return quality.score(docs, model, name=name).where(F.col(name) >= 0.5).select(*columns_of(docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or whose text is far from every language learned."""
    return language.known(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, five-word Jaccard 0.8, stays: the one with the smallest id."""
    return near_copies.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials are replaced in the texts, with ``n_chars`` to match; no document goes."""
    masked = secret_scan.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its token ids, its sequence and its offset there."""
    return packing.pack(docs, memo_words=MEMO_WORDS)


#: Encoded words that a worker of the last stage remembers; its workers hold the models of the stages before too.
MEMO_WORDS = 100_000

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]

#: Learned models, fingerprints of byte hashes and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
