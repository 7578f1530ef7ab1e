"""Built-in column expressions; everything here stays on the JVM side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The trip-length edges, in minutes, of the duration classes.
DURATION_EDGES = (5, 10, 15, 20, 30)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash32(*cols: str | Column, seed: str = "") -> Column:
    """First 32 bits of the MD5 of the columns' text, as a non-negative bigint.

    Chosen over ``hash``/``xxhash64`` where the value is user-visible (splits, folds):
    any other engine can recompute it.
    """
    parts = [_col(c).cast("string") for c in cols]
    if seed:
        parts.append(F.lit(seed))
    # a missing key still gets a value, so that no row falls out of a split
    text = F.coalesce(parts[0], F.lit("")) if len(parts) == 1 else F.concat_ws("|", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bucket_of(*cols: str | Column, buckets: int | Column, seed: str = "") -> Column:
    """Deterministic bucket 0..buckets-1 of the given key columns."""
    return hash32(*cols, seed=seed) % (F.lit(buckets) if isinstance(buckets, int) else buckets)


def whole_number(c: str | Column, to: str = "bigint") -> Column:
    """Text to integer: ``'06037'`` -> 6037, ``'2.9'`` -> 2, ``'1.2E7'`` -> 12000000, junk -> NULL.

    The digits are picked by a pattern before the cast: a failing cast raises and catches an
    exception per row, which dominates a scan of dirty text. Going through text, not double,
    keeps plain identifiers above 2**53 exact. Text with an exponent, as doubles of 10**7 and more
    are printed, or with a leading point is read as a double and truncated; out of range -> NULL.
    """
    text = F.trim(_col(c).cast("string"))
    digits = F.regexp_extract(text, r"^([+-]?\d+)(?:\.\d*)?\z", 1)
    other = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\z"), text)
    return F.when(digits != "", digits.try_cast(to)).otherwise(other.try_cast("double").try_cast(to))


def number_from_text(c: str | Column, to: str = "double") -> Column:
    """Text to floating point, junk -> NULL (tested by pattern first, as in ``whole_number``)."""
    text = F.trim(_col(c).cast("string"))
    number = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|NaN|Infinity)\z"
    return F.when(text.rlike(number), text).try_cast(to)


def duration_bin(c: str | Column, edges: Sequence[float] = DURATION_EDGES) -> Column:
    """Right-closed bins numbered from 1: value <= edges[0] -> 1, ..., above the last -> n+1."""
    value = _col(c)
    out = F.when(value <= edges[0], 1)
    for i, edge in enumerate(edges[1:], start=2):
        out = out.when(value <= edge, i)
    return out.when(value.isNotNull(), len(edges) + 1)


def word_array(c: str | Column, longer_than: int = 4, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased whitespace-separated words that are all letters, longer than the bound, no stop word.

    One pattern finds the words in place, so the many rejected pieces are never materialised.
    """
    word = rf"(?<!\S)\p{{L}}{{{longer_than + 1},}}+(?!\S)"
    words = F.regexp_extract_all(F.lower(_col(c)), F.lit(word), F.lit(0))
    stop = [w for w in stop_words if len(w) > longer_than]
    return F.filter(words, lambda w: ~w.isin(*stop)) if stop else words
