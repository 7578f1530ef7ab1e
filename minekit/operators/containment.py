"""Confidence rules as a containment join with prefix filtering.

a -> b holds above confidence c only if more than c of the users who like a like b. So b cannot miss all of
the first floor((1 - c) |a|) + 1 of them, in any order. Taken by the size of their baskets, smallest first, these
users open the fewest candidates; a basket that holds most of the items is hardly ever opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minekit.operators.scale import checkpointed, large_groups

OPENED = 64  # items of a basket up to which meeting all its pairs costs less than looking candidates up


def _ranked(liked: DataFrame, min_conf: float) -> tuple[DataFrame, DataFrame]:
    """``(user, item, freq)`` of all rows, and those of each item's prefix."""
    rows = liked.select("user", "item").distinct()
    sizes = rows.groupBy("user").agg(F.count(F.lit(1)).alias("size"))
    frequency = rows.groupBy("item").agg(F.count(F.lit(1)).alias("freq"))
    known = rows.join(frequency, "item")
    order = Window.partitionBy("item").orderBy("size", "user")
    # one more than may be missed; the small allowance covers 1 - c as a double
    missed = F.floor(F.lit(1.0 - min_conf) * F.col("freq") + F.lit(1e-9))
    prefix = known.join(sizes, "user").withColumn("at", F.row_number().over(order)).where(F.col("at") <= missed + 1)
    return known, prefix.select("user", "item", "freq")


def candidates(liked: DataFrame, min_conf: float = 0.8, min_pairs: int = 2) -> DataFrame:
    """``(item_a, item_b, freq_a)``: all pairs that may be rules, far fewer than all that occur together.

    Every rule above ``min_conf`` that at least ``min_pairs`` users support is among them. An item b with no more
    users than the rule needs is none.
    """
    known, prefix = _ranked(liked, min_conf)
    enough = (F.col("b.freq") > F.lit(min_conf) * F.col("a.freq") - 1e-9) & (
        F.least("a.freq", "b.freq") >= F.lit(min_pairs)
    )
    return (
        prefix.alias("a")
        .join(known.alias("b"), [F.col("a.user") == F.col("b.user"), F.col("a.item") != F.col("b.item"), enough])
        .select(F.col("a.item").alias("item_a"), F.col("b.item").alias("item_b"), F.col("a.freq").alias("freq_a"))
        .distinct()
    )


def rules_confidence(
    liked: DataFrame, min_conf: float = 0.8, min_pairs: int = 2, directed: bool = True, opened: int = OPENED
) -> DataFrame:
    """The rows of ``basket.rules_confidence``, counted for the candidates only.

    Rows and candidates are written once, as several passes read them. In baskets of up to ``opened`` items those of
    candidates meet each other, which moves each row once however many candidates an item has. In larger
    baskets a candidate meets the users of a and the users of b once each; hot items and users are
    skewed joins, which adaptive execution splits.
    """
    rows = checkpointed(liked.select("user", "item").distinct())
    asked = candidates(rows, min_conf, min_pairs)
    if not directed:
        asked = asked.where("item_a < item_b")
    asked = checkpointed(asked)
    pair, n = ["item_a", "item_b"], F.count(F.lit(1)).alias("n")
    wide = large_groups(rows, "user", opened).select("user")

    def side(baskets: DataFrame, item: str) -> DataFrame:
        return baskets.withColumnRenamed("item", item).join(asked.select(item).distinct(), item, "left_semi")

    small = rows.join(wide, "user", "left_anti")
    met = side(small, "item_a").join(side(small, "item_b"), "user").where("item_a != item_b").groupBy(pair).agg(n)
    large = rows.join(wide, "user", "left_semi")
    users = asked.join(large.withColumnRenamed("item", "item_a"), "item_a")
    looked_up = users.join(large.withColumnRenamed("item", "item_b"), ["item_b", "user"]).groupBy(pair).agg(n)
    return (
        met.unionByName(looked_up)
        .groupBy(pair)
        .agg(F.sum("n").alias("n"))
        .join(asked.withColumnRenamed("freq_a", "n_a"), pair)
        .withColumn("confidence", F.col("n").cast("double") / F.col("n_a"))
        .where((F.col("n") >= min_pairs) & (F.col("confidence") > F.lit(float(min_conf))))
        .select("item_a", "item_b", "n", "n_a", "confidence")
        .orderBy(F.desc("n"), "item_a", "item_b")
    )
