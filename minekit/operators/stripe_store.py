"""Pair counts and stripes that are kept up to date, batch by batch.

A store is a folder with the liked rows and the pair counts that each batch added. A batch only opens
the baskets it touches: new rows meet each other and the old rows of their users, while two old rows were
counted before. Counts are sums over batches, so nothing stored is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators.basket import BASKET_BLOCK, LIST_BLOCK, pair_counts_apart
from minekit.operators.basket import item_stripes as stripes_of


def create(spark: SparkSession, path: str, user: str = "long", item: str = "long") -> None:
    """An empty store at an unused path, for ids of these types."""
    spark.createDataFrame([], f"user {user}, item {item}").write.parquet(f"{path}/liked/batch=0")
    empty = spark.createDataFrame([], f"item_a {item}, item_b {item}, n long")
    empty.write.parquet(f"{path}/pairs/batch=0")


def liked(spark: SparkSession, path: str) -> DataFrame:
    """``(user, item)``: all rows of the finished batches, each once."""
    return spark.read.parquet(f"{path}/liked").select("user", "item")


def add(spark: SparkSession, path: str, batch: int, rows: DataFrame, block: int = BASKET_BLOCK) -> None:
    """Add the ``(user, item)`` of a batch, numbered from 1 on; rows that the store has already change nothing.

    The liked rows are written last and finish the batch. One that failed before is not seen by readers, and is
    simply added again under its number; a number that is finished must not be used again.
    """
    if batch < 1:
        raise ValueError("batches are numbered from 1 on")
    finished = [r["batch"] for r in spark.read.parquet(f"{path}/liked").select("batch").distinct().collect()]
    if batch in finished:
        raise ValueError(f"batch {batch} is in the store already")
    stored = liked(spark, path)
    fresh = f"{path}/staged/batch={batch}"
    complete = F.col("user").isNotNull() & F.col("item").isNotNull()
    new = rows.select("user", "item").where(complete).distinct().join(stored, ["user", "item"], "left_anti")
    # written before it is used three times: all uses see the same rows
    new.write.mode("overwrite").parquet(fresh)
    new = spark.read.schema(stored.schema).parquet(fresh)
    old = stored.join(new.select("user").distinct(), "user", "left_semi").withColumn("known", F.lit(True))
    touched = old.unionByName(new.withColumn("known", F.lit(False)))
    pair_counts_apart(touched, "known", block=block).write.mode("overwrite").parquet(f"{path}/pairs/batch={batch}")
    new.write.mode("overwrite").parquet(f"{path}/liked/batch={batch}")


def pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """``(item_a, item_b, n)`` over all finished batches."""
    # a batch without new rows leaves no liked rows and no pairs; one that is not finished has pairs only
    finished = spark.read.parquet(f"{path}/liked").select("batch").distinct()
    # one row per batch, hence the broadcast: dealt by batch, all pairs of a batch would meet in one task
    pairs = spark.read.parquet(f"{path}/pairs").join(F.broadcast(finished), "batch", "left_semi")
    return pairs.groupBy("item_a", "item_b").agg(F.sum("n").alias("n"))


def item_stripes(spark: SparkSession, path: str, max_entries: int = LIST_BLOCK) -> DataFrame:
    """``(item_a, part, stripe)`` of the whole store, as ``basket.item_stripes``."""
    return stripes_of(pair_counts(spark, path), max_entries)
