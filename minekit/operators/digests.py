"""Distinct texts by digests: texts stay where they were read unless another row may hold the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.operators.scale import scratch_path


def repeated_digests(df: DataFrame, text: str) -> DataFrame:
    """``digest`` of every 64-bit text digest that two or more rows have.

    Only digests are shuffled, counted on the map side first, so a text that a third of all rows
    share is one row per task. The result is written to the shared folder and read again: from
    then on its size is known and decides how it is joined.
    """
    path = scratch_path(df.sparkSession, "repeated-digests")
    digests = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("digest"))
    counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    counted.where("n > 1").select("digest").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def distinct_texts(df: DataFrame, text: str, key: str) -> DataFrame:
    """``(id, value)``: every different non-null text with the smallest key among its copies.

    A text whose digest no other row has is distinct without a look at it and passes in place. Texts
    with a repeated digest are grouped by the whole text, so equal digests of different texts stay
    apart; copies collapse on the map side. The written digests are broadcast while they are below
    the session's broadcast limit; beyond it the join shuffles, as a plain distinct would.
    A NULL key counts as larger than any other. An empty table gives no rows.
    """
    repeated = repeated_digests(df, text).select(F.col("digest").alias("_again"))
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("value"))
    marked = rows.join(repeated, F.xxhash64("value") == F.col("_again"), "left")
    alone = marked.where("_again IS NULL").select("id", "value")
    copies = marked.where("_again IS NOT NULL").groupBy("value").agg(F.min("id").alias("id"))
    return alone.unionByName(copies.select("id", "value"))
