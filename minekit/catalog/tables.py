"""Adapters from the star-schema tables to the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.functions import duration_bin

LIKED_QUANTITY = 40.0
BRAND_QUANTITY = 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, item, rating)``: customer, part, ordered quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user"),
        F.col("l_partkey").alias("item"),
        F.col("l_quantity").alias("rating"),
    )


def brand_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, item, rating)`` with the brand as item: few items, dense baskets."""
    brands = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (
        part_ratings(spark, sf_dir)
        .join(brands, F.col("item") == F.col("p_partkey"))
        .select("user", F.col("p_brand").alias("item"), "rating")
    )


def mean_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rating of 0.1..5.0 per customer and part."""
    return (
        part_ratings(spark, sf_dir)
        .groupBy("user", "item")
        .agg((F.avg("rating") / 10).cast("float").alias("rating"))
    )


def part_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item"), F.col("p_name").alias("title")
    )


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with gaps: type "error", small JSON values and small amounts count as missing."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("kind"),
        F.when(k >= 10, k).alias("k"),
        F.when(F.col("value") >= 5.0, F.col("value")).alias("amount"),
        (F.col("user_id") % 10).alias("grp"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(user, item, rating, score)``: a ranking with a reproducible score column."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("user"),
        F.col("event_id").alias("item"),
        F.col("value").alias("rating"),
        ((F.col("event_id") * 37) % 101).alias("score"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as trips: quantity plays the minutes; ``amount`` depends on three of the features."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        F.dayofweek("l_shipdate").alias("day_of_week"),
        duration_bin("l_quantity").alias("duration_bin"),
        (F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("amount"),
    )


def english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
