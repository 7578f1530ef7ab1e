"""Pair counts, stripes, confidence rules and lift rules from headerless rating and item files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators import basket
from minekit.operators.prep import typed_projection
from minekit.sources import output_path, read_headerless, write_text


def _liked(spark: SparkSession, ratings_path: str) -> DataFrame:
    raw = read_headerless(spark, ratings_path).select(
        F.col("_c0").alias("user"), F.col("_c1").alias("item"), F.col("_c2").alias("rating")
    )
    typed = typed_projection(raw, {"user": "bigint", "item": "bigint", "rating": "double"})
    return basket.liked_items(typed)


def _titles(spark: SparkSession, items_path: str) -> DataFrame:
    raw = read_headerless(spark, items_path).select(
        F.col("_c0").alias("item"), F.col("_c1").alias("title")
    )
    return typed_projection(raw, {"item": "bigint", "title": "string"}).where(F.col("item").isNotNull())


def pairs(spark: SparkSession, ratings_path: str, items_path: str, out_dir: str) -> str:
    """``item_a,item_b,title_a,title_b,n``, most frequent first."""
    counts = basket.pair_counts(_liked(spark, ratings_path))
    named = basket.with_titles(counts, ["item_a", "item_b"], _titles(spark, items_path))
    out = output_path(out_dir, "pairs-", ratings_path)
    write_text(basket.by_count(named).select("item_a", "item_b", "title_a", "title_b", "n"), out, "\t")
    return out


def stripes(spark: SparkSession, ratings_path: str, items_path: str, out_dir: str) -> str:
    """``title <tab> title:n;title:n;...`` per item; very long stripes take several lines."""
    counts = basket.pair_counts(_liked(spark, ratings_path))
    named = basket.stripes_named(counts, _titles(spark, items_path))
    cells = F.transform("stripe", lambda e: F.concat_ws(":", e["title"], e["n"].cast("string")))
    out = output_path(out_dir, "stripe-", ratings_path)
    write_text(named.select("title_a", F.array_join(cells, ";").alias("stripe")), out, "\t")
    return out


def confidence(spark: SparkSession, ratings_path: str, items_path: str, out_dir: str) -> str:
    """``title_a, title_b, n, n_a, confidence``, most frequent first."""
    rules = basket.rules_confidence(_liked(spark, ratings_path))
    named = basket.with_titles(rules, ["item_a", "item_b"], _titles(spark, items_path))
    out = output_path(out_dir, "conditional-", ratings_path)
    ordered = basket.by_count(named).select("title_a", "title_b", "n", "n_a", "confidence")
    write_text(ordered, out, "\t")
    return out


def lift(spark: SparkSession, ratings_path: str, items_path: str, out_dir: str) -> str:
    """``title_a, title_b, lift``, highest lift first."""
    rules = basket.rules_lift(_liked(spark, ratings_path))
    named = basket.with_titles(rules, ["item_a", "item_b"], _titles(spark, items_path))
    out = output_path(out_dir, "Lift-", ratings_path)
    ordered = named.orderBy(F.desc("lift"), "item_a", "item_b").select("title_a", "title_b", "lift")
    write_text(ordered, out, "\t")
    return out
