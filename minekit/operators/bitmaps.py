"""Pair counts by vertical bitmaps: which users like an item, one bit each.

Users are numbered within hash buckets and lie in blocks of 1,024. A dense item, one that at least every
``SHARE``-th user likes, has a row of sixteen words a block; two of them share as many users of the block
as the AND of their words has bits. So a pair of dense items costs one row a block, and not one for every user
who likes both. All other pairs, with at most few users, are counted from the baskets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minekit.operators import basket
from minekit.operators.scale import checkpointed

WORDS = 16
BLOCK_USERS = 64 * WORDS
#: Up to this share a block's row is no more than the rows of the baskets: 1024 / 32 / 32 users like both.
SHARE = 32
_FILL = 768  # users of a bucket on average, so that most buckets are one block


def item_bits(rows: DataFrame, n_users: int, *carried: str) -> DataFrame:
    """``(bucket, chunk, item, w0 .. w15, *carried)``: the bits of the users who like the item, by block of users.

    A user's place is its rank among the users of its hash bucket; a bucket that has more users than a
    block goes on in further chunks. Rows that repeat set the same bit. ``n_users`` decides how many buckets
    there are and may be rough; ``carried`` are facts of the item.
    """
    users = rows.select("user").distinct()
    buckets = F.lit(max(1, math.ceil(n_users / _FILL))).cast("bigint")
    place = Window.partitionBy("bucket").orderBy("user")
    numbered = (
        users.withColumn("bucket", F.pmod(F.xxhash64(F.col("user").cast("string")), buckets))
        .withColumn("at", F.row_number().over(place) - 1)
        .select(
            "user",
            "bucket",
            F.floor(F.col("at") / BLOCK_USERS).cast("int").alias("chunk"),
            F.floor(F.col("at") % BLOCK_USERS / 64).cast("int").alias("word"),
            F.expr("shiftleft(1L, at % 64)").alias("bit"),
        )
    )
    none = F.lit(0).cast("bigint")
    words = [F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), none).alias(f"w{k}") for k in range(WORDS)]
    facts = [F.max(c).alias(c) for c in carried]
    return rows.join(numbered, "user").groupBy("bucket", "chunk", "item").agg(*words, *facts)


def dense_pairs(rows: DataFrame, n_users: int) -> DataFrame:
    """``(item_a, item_b, n, freq_a, freq_b)`` of all pairs among ``(user, item, freq)`` that occur.

    Buckets are even by their hash, and each needs as many rows as items only; they keep their own
    partitions, since adaptive coalescing would judge them by bytes and not by the pairs they make.
    """
    bits = item_bits(rows, n_users, "freq")
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = bits.repartition(slices, "bucket", "chunk")
    x, y = bits.alias("x"), bits.alias("y")
    met = x.join(
        y,
        [F.col("x.bucket") == F.col("y.bucket"), F.col("x.chunk") == F.col("y.chunk"), F.col("x.item") < F.col("y.item")],
    )
    both = F.bit_count(F.col("x.w0").bitwiseAND(F.col("y.w0")))
    for k in range(1, WORDS):
        both = both + F.bit_count(F.col(f"x.w{k}").bitwiseAND(F.col(f"y.w{k}")))
    return (
        met.select(
            F.col("x.item").alias("item_a"),
            F.col("y.item").alias("item_b"),
            both.cast("bigint").alias("n"),
            F.col("x.freq").alias("freq_a"),
            F.col("y.freq").alias("freq_b"),
        )
        .where("n > 0")
        .groupBy("item_a", "item_b")
        .agg(F.sum("n").alias("n"), F.max("freq_a").alias("freq_a"), F.max("freq_b").alias("freq_b"))
    )


def pair_frequencies(
    liked: DataFrame, min_pairs: int = 1, block: int = basket.BASKET_BLOCK, share: int = SHARE
) -> DataFrame:
    """``basket.pair_frequencies``, with the pairs of dense items counted by their bitmaps.

    The distinct rows are written once, since users, frequencies and bits all come from them. Baskets are only opened
    for users who like an item that is not dense; without such an item there is no join of baskets at all.
    """
    rows = checkpointed(liked.select("user", "item").distinct())
    users = rows.select("user").distinct().count()
    frequency = rows.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= min_pairs)
    frequency = frequency.withColumn("dense", F.col("freq") * share >= users)
    flagged = rows.join(frequency, "item")
    by_bits = dense_pairs(flagged.where("dense").select("user", "item", "freq"), users)
    by_bits = by_bits.where(F.col("n") >= min_pairs)
    if frequency.where("not dense").isEmpty():
        return by_bits
    mixed = flagged.where("not dense").select("user").distinct()
    baskets = flagged.select("user", "item", "dense").join(mixed, "user", "left_semi")
    # frequencies of the whole table, not of the baskets that are opened
    counted = basket.pair_counts_apart(baskets, "dense", 1, block).where(F.col("n") >= min_pairs)
    for side in ("a", "b"):
        counted = counted.join(
            frequency.select(F.col("item").alias(f"item_{side}"), F.col("freq").alias(f"freq_{side}")), f"item_{side}"
        )
    return by_bits.unionByName(counted.select(*by_bits.columns))


def pair_counts(liked: DataFrame, min_pairs: int = 1, share: int = SHARE) -> DataFrame:
    """``basket.pair_counts`` by bitmaps where items are dense."""
    return pair_frequencies(liked, min_pairs, share=share).select("item_a", "item_b", "n")


def rules_confidence(
    liked: DataFrame, min_conf: float = 0.8, min_pairs: int = 2, directed: bool = True, share: int = SHARE
) -> DataFrame:
    """``basket.rules_confidence`` with dense items counted by their bitmaps."""
    return basket.by_confidence(pair_frequencies(liked, min_pairs, share=share), min_conf, directed)
