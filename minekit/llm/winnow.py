"""Winnowing fingerprints of texts; DataFrame functions only.

A text is cut into words (ideographs stand alone, very long words are cut). Every run of ``K``
words has a Karp-Rabin hash; of every ``WINDOW`` consecutive hashes the smallest is chosen, of equal ones
the rightmost, and its position is kept. Two texts that share ``K + WINDOW - 1`` consecutive words
therefore share a chosen hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import let, text_of, written
from minekit.operators.scale import number_rows

K = 3
WINDOW = 4
# The code points from the CJK radicals to the compatibility ideographs, and the later planes.
_ALONE = r"\u2E80-\uFAFF\x{20000}-\x{3FFFF}"
WORD = rf"[^\s{_ALONE}]{{1,12}}|\S"
_PRIME = 2**31 - 1
_BASE = 1_000_003
_POSITIONS = 2**32  # a hash below 2**31 and a position share a long


def chosen(text: Column) -> Column:
    """Chosen hashes as longs: hash * 2**32 + (2**32 - 1 - position), in the order of the text.

    Packed this way the smallest long of a window is the smallest hash, rightmost among equals.
    A text of fewer than ``K`` words is filled up and has one hash, a text without words none.
    """
    scale = [pow(_BASE, K - 1 - j, _PRIME) for j in range(K)]

    def grams(h: Column) -> Column:
        # K = 3 terms below 2**62, 2**62 and 2**31 fit into a long, so one remainder is enough
        def packed(x: Column, i: Column) -> Column:
            rest = [F.get(h, i + j) * F.lit(scale[j]) for j in range(1, K - 1)]
            hashed = (sum(rest, x * F.lit(scale[0])) + F.get(h, i + (K - 1))) % _PRIME
            return hashed * F.lit(_POSITIONS) + (F.lit(_POSITIONS - 1) - i)

        return F.slice(F.transform(h, packed), F.lit(1), F.size(h) - (K - 1))

    def minima(v: Column) -> Column:
        # minima of two, then of two of these; least() skips what lies beyond the end
        half = WINDOW // 2
        pairs = F.transform(v, lambda x, i: F.least(x, *[F.get(v, i + j) for j in range(1, half)]))
        whole = let(pairs, lambda p: F.transform(p, lambda x, i: F.least(x, F.get(p, i + half))))
        windows = F.greatest(F.size(v) - (WINDOW - 1), F.lit(1))
        return F.array_distinct(F.slice(whole, F.lit(1), windows))

    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    hashes = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(_PRIME)))
    filled = lambda h: F.concat(h, F.array_repeat(F.lit(0).cast("long"), F.lit(K) - F.size(h)))
    none = F.array().cast("array<bigint>")
    return let(
        hashes,
        lambda h: F.when(F.size(h) == 0, none)
        .when(F.size(h) < K, let(filled(h), lambda f: let(grams(f), minima)))
        .otherwise(let(grams(h), minima)),
    )


def hashes_of(packed: Column) -> Column:
    """The distinct hashes of ``chosen``, which fit into ints."""
    return F.array_distinct(F.transform(packed, lambda v: F.shiftright(v, 32).cast("int")))


def places_of(packed: Column) -> Column:
    """``chosen`` as an array of (hash, position)."""
    return F.transform(
        packed,
        lambda v: F.struct(
            F.shiftright(v, 32).alias("hash"),
            (F.lit(_POSITIONS - 1) - v.bitwiseAND(F.lit(_POSITIONS - 1))).alias("position"),
        ),
    )


def likeness(a: Column, b: Column) -> Column:
    """Shared part of two hash sets; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - shared
    return F.when(union == 0, 1.0).otherwise(shared / union)


def digest(packed: Column) -> Column:
    """A fingerprint as text: SHA-256 over its hashes and positions."""
    return F.sha2(F.array_join(packed.cast("array<string>"), ","), 256)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint)``, the fingerprint as an array of (hash, position).

    A missing text counts as empty and has an empty array; all rows, repeated ones and those
    without an id included, keep their own result. No shuffle.
    """
    return df.select(
        F.col(id_col).alias("doc_id"), places_of(chosen(text_of(text_col))).alias("fingerprint")
    )


def edited_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text, its edited form, and the chosen hashes of both and of the next document.

    The next document follows in descending id, then by text hash; rows without an id stand last,
    and the first follows the last. Rows equal in id and text hold one place in that order, and
    each of them is returned. Only ids, hashes and lengths are numbered; the texts are shuffled
    once by key, then each document sends its predecessor the beginning that it asks for
    and its own hashes.
    """
    text = text_of(text_col)
    keyed = df.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn(
        "key",
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text"))),
    )
    narrow = written(
        keyed.select("key", "doc_id", F.length("text").alias("n_chars")).distinct(), "winnow-keys"
    )
    order = [F.col("doc_id").desc_nulls_last(), F.col("key")]
    numbered = written(number_rows(narrow, order), "winnow-order")
    total = numbered.count()
    asks = numbered.select(
        F.col("key").alias("asker"),
        F.floor(F.col("n_chars") / 3).cast("int").alias("wanted"),
        ((F.col("idx") + 1) % F.lit(max(total, 1))).alias("idx"),
    ).join(numbered.select("idx", "key"), "idx")
    texts = keyed.groupBy("key").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")
    )
    # with the id and the number of copies both uses of the texts ask for the same columns, so that
    # one shuffle serves them
    beginnings = texts.where("copies > 0").join(asks, "key").select(
        F.col("asker").alias("key"),
        F.col("doc_id").alias("next_id"),
        F.substring(F.col("text"), F.lit(1), F.col("wanted")).alias("beginning"),
        hashes_of(chosen(F.col("text"))).alias("next_hashes"),
    )
    n_chars = F.length("text")
    stay = n_chars - F.floor(n_chars / 3).cast("int")
    pairs = texts.join(beginnings, "key").select(
        "doc_id",
        "text",
        "copies",
        F.concat(F.substring(F.col("text"), F.lit(1), stay), F.col("beginning")).alias("edited"),
        "next_id",
        "next_hashes",
    )
    return (
        pairs.withColumn("packed", chosen(F.col("text")))
        .withColumn("edited_packed", chosen(F.col("edited")))
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .drop("copy", "copies")
    )


def digest_columns(pairs: DataFrame) -> DataFrame:
    """The query's columns from ``edited_pairs``."""
    own, edited = hashes_of(F.col("packed")), hashes_of(F.col("edited_packed"))
    both = let(
        own,
        lambda a: F.struct(
            likeness(a, edited).alias("near_edited"), likeness(a, F.col("next_hashes")).alias("near_next")
        ),
    )
    return pairs.select(
        "doc_id",
        "next_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        digest(F.col("packed")).alias("fingerprint"),
        digest(F.col("edited_packed")).alias("edited_fingerprint"),
        both.alias("near"),
    ).select("*", "near.*").drop("near")
