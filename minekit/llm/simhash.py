"""SimHash near-duplicates by bit-sliced comparison.

A fingerprint has a bit set if more than half of the hashes of the text's word triples have it.
Distinct fingerprints are cut into two blocks more than the bits in which two may differ (four blocks of 16
bits for two bits); then at least two blocks are equal, so they meet under a key of two blocks (one of
six). Fingerprints under keys that occur more than once are compared in tiles: the 64 bits of a tile's
fingerprints lie in 64 planes of machine words, and bitwise counters sum the differences of 64 at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import importable, text_of, written

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints compared in one piece; larger groups of a key are compared tile against tile.
TILE = 1024
_LEAST_BLOCKS, _BLOCK_BITS = 4, 16  # the widest block has 16 bits


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the text's runs of ``size`` words, repeats included; fewer words are one run, none have none."""
    words = text.encode().lower().split()  # bytes: only A-Z and the six blanks count
    if not words:
        return np.zeros(0, np.uint64)
    n = max(len(words) - size + 1, 1)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: the bits that more than half of the hashes have; zero without hashes."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``(doc_id, bits)`` of every row, or with ``keep`` all columns of ``df`` and ``_bits``.

    ``bits`` is the fingerprint as a signed long. A text without words, a missing one among
    them, has zero; one of fewer words than a shingle is a single shingle.
    """

    @F.pandas_udf("bigint")
    def bits(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([majority(shingle_hashes(t)) for t in texts], np.uint64).view(np.int64))

    importable(df.sparkSession)
    made = bits(text_of(text_col))
    return df.withColumn("_bits", made) if keep else df.select(F.col(id_col).alias("doc_id"), made.alias("bits"))


# --- bit-sliced comparison ------------------------------------------------------------------


def planes(bits: np.ndarray) -> np.ndarray:
    """64 planes of fingerprints: bit k of fingerprint i is bit i % 64 of word (k, i // 64)."""
    lanes = -(-len(bits) // 64) * 64
    each = np.zeros((lanes, 64), np.uint8)
    each[: len(bits)] = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(each.T), axis=1, bitorder="little").view(np.uint64)


def close_pairs(
    queries: np.ndarray, tile: np.ndarray, step: int = 8, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, tile) of fingerprints that differ in at most ``radius`` bits.

    The counters of one query against 64 fingerprints are a word per binary digit, and one for those
    beyond the radius for good. A difference is added with carries; after every ``step`` planes the blocks of 64
    that are all beyond the radius are abandoned.
    """
    stacked, lanes = planes(tile), len(tile)
    words = stacked.shape[1]
    beyond_end = np.zeros(words * 64, np.uint8)
    beyond_end[lanes:] = 1
    shape = len(queries), words
    # a block is one query against one word of 64 fingerprints
    query, word = (x.ravel() for x in np.indices(shape))
    over = np.broadcast_to(np.packbits(beyond_end, bitorder="little").view(np.uint64), shape).ravel()
    first = radius + 1  # the first count beyond the radius; a counter that gets there stays beyond
    digits = [np.zeros_like(over) for _ in range(first.bit_length())]
    for k in range(64):
        mask = np.uint64(0) - ((queries >> np.uint64(k)) & np.uint64(1))
        carry = stacked[k][word] ^ mask[query]
        there = None
        for d, digit in enumerate(digits):
            digits[d], carry = digit ^ carry, digit & carry
            same = digits[d] if first >> d & 1 else ~digits[d]
            there = same if there is None else there & same
        over = over | carry | there
        if k % step == step - 1:
            going = over != ~np.uint64(0)
            query, word, over = query[going], word[going], over[going]
            digits = [digit[going] for digit in digits]
            if not len(query):
                break
    near = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, lane = np.nonzero(near)
    return query[block], 64 * word[block] + lane


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each of ``n`` nodes under the links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def _links(
    values: np.ndarray, others: np.ndarray | None = None, radius: int = RADIUS
) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the components of close fingerprints: (fingerprint, smallest of its component)."""
    nodes = np.unique(values if others is None else np.concatenate([values, others]))
    tile = nodes if others is None else np.unique(others)
    queries = nodes if others is None else np.unique(values)
    at_q, at_t = np.searchsorted(nodes, queries), np.searchsorted(nodes, tile)
    a, b = [at_q[:0]], [at_t[:0]]
    unsigned_q, unsigned_t = queries.view(np.uint64), tile.view(np.uint64)
    for i in range(0, len(queries), 512):
        for j in range(0, len(tile), TILE):
            q, t = close_pairs(unsigned_q[i : i + 512], unsigned_t[j : j + TILE], radius=radius)
            a.append(at_q[q + i])
            b.append(at_t[t + j])
    root = _forest(len(nodes), np.concatenate(a), np.concatenate(b))
    linked = root != np.arange(len(nodes))
    return nodes[linked], nodes[root[linked]]


def _keys(bits: Column, radius: int = RADIUS) -> Column:
    blocks = max(radius + 2, _LEAST_BLOCKS)
    ends = [64 * i // blocks for i in range(blocks + 1)]
    block = [F.shiftright(bits, a).bitwiseAND(F.lit(2 ** (b - a) - 1)) for a, b in zip(ends, ends[1:])]
    return F.array(
        *[
            F.lit(n << 32).bitwiseOR(F.shiftleft(block[i], _BLOCK_BITS)).bitwiseOR(block[j])
            for n, (i, j) in enumerate(combinations(range(blocks), 2))
        ]
    )


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b)`` with a > b: links that connect all fingerprints of ``bits`` within the radius.

    Keys of one fingerprint are left out first. A key of more than ``TILE`` fingerprints is dealt
    into parts by hash, and every two parts meet in one task, so no group is too large and no
    link is lost. A task compares small groups together: what is close under different keys is
    close all the same. Each tile returns a spanning forest of its links, not all of them.
    """
    keyed = distinct.select("bits", F.explode(_keys(F.col("bits"), radius)).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("size") / TILE).cast("int"))
    # part p meets every other part once, in the pair (smaller, larger)
    mine = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    dealt = (
        shared.withColumn("mine", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "bits",
            F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.least("mine", "other")).alias("low"),
            F.when(F.col("parts") == 1, F.lit(-1)).otherwise(F.greatest("mine", "other")).alias("high"),
            "mine",
            "key",
        )
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(values: np.ndarray, others: np.ndarray | None = None) -> pd.DataFrame:
            return pd.DataFrame(dict(zip("ab", _links(values, others, radius))))

        def compared(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            """All groups of ``rows``, each of them whole."""
            bits, mine = rows["bits"].to_numpy(), rows["mine"].to_numpy()
            low, high = rows["low"].to_numpy(), rows["high"].to_numpy()
            names = rows[["key", "low", "high"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
            begin = 0  # of the small groups that wait to be compared together
            for start, end in zip(starts, [*starts[1:], len(rows)]):
                if low[start] >= 0:
                    if begin < start:
                        yield out(bits[begin:start])
                    own = bits[start:end]
                    if low[start] == high[start]:
                        yield out(own)
                    else:
                        first = mine[start:end] == low[start]
                        yield out(own[first], own[~first])
                    begin = end
                elif end - begin >= TILE:
                    yield out(bits[begin:end])
                    begin = end
            if begin < len(rows):
                yield out(bits[begin:])

        rest: pd.DataFrame | None = None
        for batch in batches:
            # groups arrive together; the last one of a batch may go on in the next
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows.empty:
                continue
            names = rows[["key", "low", "high"]].to_numpy()
            last = (names == names[-1]).all(axis=1)
            rest = rows[last]
            if not last.all():
                yield from compared(rows[~last])
        if rest is not None:
            yield from compared(rest)

    importable(distinct.sparkSession)
    return (
        dealt.repartition("key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "bits")
        .select("bits", "low", "high", "mine", "key")
        .mapInPandas(compare, "a bigint, b bigint")
        .distinct()
    )


# --- components -----------------------------------------------------------------------------


def _star(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours, then smaller ones, are hung on the smallest neighbour.

    Only minima are gathered for a node, never its neighbours, so a centre of many links is a
    skewed join at most.
    """
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(a, b)``: every linked node but the smallest of its component, and that smallest node.

    Stars of smallest neighbours, in rounds whose number grows with the logarithm of the longest
    chain. Each round is written to the shared folder, so a lost executor costs one round at most.
    """
    edges = written(edges.where("a > b").distinct(), "links")
    while True:
        # done if no node hangs on another and is hung upon too, and none hangs on two
        roots, hung = edges.select(F.col("b").alias("a")).distinct(), edges.select("a")
        if hung.count() == hung.distinct().count() and hung.join(roots, "a", "left_semi").isEmpty():
            return edges
        edges = written(_star(edges), "stars")


def grouped(prints: DataFrame) -> DataFrame:
    """``(bits, component_id)`` of the distinct fingerprints of ``(doc_id, bits)``.

    The component's id is its smallest document id; null if none of its documents has one.
    """
    distinct = written(prints.groupBy("bits").agg(F.min("doc_id").alias("low")), "fingerprints")
    found = components(links(distinct))
    rooted = distinct.join(found.select(F.col("a").alias("bits"), F.col("b").alias("root")), "bits", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "bits"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return written(rooted.join(lows, "root").select("bits", "component_id"), "components")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, bits, component_id)`` of every row.

    Texts are linked if their fingerprints differ in at most two bits; those without words, which
    have fingerprint zero, like any others. Rows that repeat and rows without an id stay. Copies
    share a fingerprint and are compared once. An empty table gives an empty one.
    """
    prints = written(fingerprints(df, id_col, text_col), "prints")
    return prints.join(grouped(prints), "bits").select("doc_id", "bits", "component_id")


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` of which each stands for its component: the one with the smallest id.

    Of several rows with that id the one with the smallest text hash stays, of equal rows one; rows
    without an id come last. All columns stay. The texts are shuffled once.
    """
    key = "_row_key"
    names = [F.coalesce(F.col(id_col).cast("string"), F.lit("-")), F.hex(F.xxhash64(text_of(text_col)))]
    keyed = df.withColumn(key, F.concat_ws(":", *names))
    prints = written(
        fingerprints(keyed, id_col, text_col, keep=True).select(
            F.col(id_col).alias("doc_id"), F.col("_bits").alias("bits"), F.col(key).alias("key")
        ),
        "prints",
    )
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    distinct = prints.groupBy("bits").agg(F.min(ordered).alias("first"))
    found = components(links(distinct.select("bits")))
    stays = (
        distinct.join(found.select(F.col("a").alias("bits"), F.col("b").alias("root")), "bits", "left")
        .groupBy(F.coalesce("root", "bits").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias(key))
    )
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kept = keyed.join(written(stays, "survivors"), key, "left_semi")
    return kept.groupBy(key).agg(F.first(whole).alias("row")).select("row.*")


def digest_columns(found: DataFrame) -> DataFrame:
    bits = F.lpad(F.lower(F.hex("bits")), 16, "0")
    return found.select("doc_id", bits.alias("fingerprint"), "component_id")
