"""Token counts with a digest cache: a text that was ever counted is not encoded again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of
from minekit.llm.encode import token_counter

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
CACHE = "tokenizer string, digest string, n_tokens bigint"


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: the digest of its file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(
    df: DataFrame,
    cache_path: str,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens)`` of every row; new texts are added to the cache.

    ``cache_path`` is a Parquet folder of ``(tokenizer, digest, n_tokens)`` that all executors
    reach; it may be missing. One job at a time may write it. The content is the whole text
    unchanged, since the vocabulary tells case and blanks apart; a missing text is the empty
    one with no tokens. Equal texts are encoded once, however many rows hold them; repeated rows
    and rows without an id stay. Other columns are not looked at.
    """
    spark = df.sparkSession
    path = tokenizer_path or public_tokenizers.path(TOKENIZER)
    version = tokenizer_digest(path)
    keyed = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "digest", F.sha2("text", 256)
    )
    # an empty append makes the folder, so that a first run reads like any other
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache_path)

    def known() -> DataFrame:
        cache = spark.read.schema(CACHE).parquet(cache_path)
        # two jobs that ran at once may both have appended a digest, with the same count
        counts = cache.where(F.col("tokenizer") == version).groupBy("digest")
        return counts.agg(F.max("n_tokens").alias("n_tokens"))

    # copies are combined before the shuffle; the second step reuses its partitioning
    texts = keyed.groupBy("digest").agg(F.first("text").alias("text"))
    misses = texts.join(known().select("digest"), "digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = token_counter(path)
        for batch in batches:
            counts = [counter.count(t) for t in batch["text"]]
            yield pd.DataFrame({"tokenizer": version, "digest": batch["digest"], "n_tokens": counts})

    importable(df.sparkSession)
    misses.mapInPandas(encode, CACHE).write.mode("append").parquet(cache_path)
    rows = keyed.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    return rows.join(known(), "digest").select("doc_id", "n_bytes", "n_tokens")


def digest_columns(counted: DataFrame, limit: int = LIMIT) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
