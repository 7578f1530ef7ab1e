"""Dense ids from a stored dictionary, the same in every run.

The dictionary is a folder of ``(key, idx)`` that only grows: keys that it does not have get the next
numbers in the order of the keys, all others keep theirs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators.scale import number_rows


def create(spark: SparkSession, path: str, kind: str = "long") -> None:
    """An empty dictionary at an unused path, for keys of this type."""
    spark.createDataFrame([], f"key {kind}, idx long").write.parquet(f"{path}/batch=0")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``(key, idx)`` of all keys so far."""
    return spark.read.parquet(path).select("key", "idx")


def extend(spark: SparkSession, path: str, keys: DataFrame, key: str, batch: int) -> None:
    """Number the keys that are new, from the largest number on; a NULL key gets none.

    A batch that fails leaves nothing behind that is read, and can be extended again under its number. One
    writer at a time: two that run together would give the same numbers twice.
    """
    if batch < 1:
        raise ValueError("batches are numbered from 1 on")
    known = entries(spark, path)
    new = keys.select(F.col(key).alias("key")).where(F.col("key").isNotNull()).distinct()
    new = new.join(known.select("key"), "key", "left_anti")
    start = known.agg(F.coalesce(F.max("idx") + 1, F.lit(0)).alias("start")).first()["start"]
    numbered = number_rows(new, ["key"]).select("key", (F.col("idx") + F.lit(start)).cast("bigint").alias("idx"))
    numbered.write.mode("errorifexists").parquet(f"{path}/batch={batch}")


def encoded(df: DataFrame, path: str, key: str) -> DataFrame:
    """``df`` with ``key`` replaced by its number, NULL where the dictionary has none."""
    known = entries(df.sparkSession, path).withColumnRenamed("key", "_key")
    others = [F.col(f"`{c}`") if c != key else F.col("idx").alias(key) for c in df.columns]
    return df.join(known, F.col(key) == F.col("_key"), "left").select(*others)
