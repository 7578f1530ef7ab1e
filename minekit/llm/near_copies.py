"""Near copies by SimHash: fingerprints within a radius are candidates, and are then compared exactly.

Texts are sets of hashed five-word shingles and have the SimHash fingerprint of these shingles. Sets whose
fingerprints lie in one component of links of at most ``RADIUS`` bits are candidates. Beside them are those that share
a band of min-hashes, since near copies of similarity 0.8 may differ in more bits than any radius that
is cheap to search: two such sets share no band with probability (1 - 0.8 ** ROWS) ** BANDS, three in a million.
Candidates are compared exactly in two steps: each set with the smallest set of its bands, which
joins most copies of one text in linear work; then, in groups of candidates that are still apart, every pair
of sets of which not both belong to the group's largest part. Only digests travel until then; the hashes of
sets that have candidates are written once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import columns_of, importable, text_of, unused, written
from minekit.llm.simhash import SEED, components, links, majority, shingle_hashes

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 6
BANDS, ROWS = 32, 5
#: Sets, and shingles of them, in one part of a group; two parts meet in one task.
TILE, TILE_SHINGLES = 4096, 2_000_000
#: Shingles that so many sets of a task have are counted by bits, the others by lists.
FREQUENT = 32
_RNG = np.random.default_rng(SEED)
_MASKS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


# --- sets -----------------------------------------------------------------------------------


def as_set(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes; a text without words has the hash of nothing."""
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the text's runs of ``size`` words; a shorter text is one shingle, an empty one too."""
    return as_set(shingle_hashes(text, size))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band of min-hashes."""
    low = np.full(BANDS * ROWS, 2**32 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        mixed = hashes[i : i + 1024, None] ^ _MASKS
        mixed *= _FACTORS
        mixed >>= np.uint64(32)
        np.minimum(low, mixed.min(axis=0), out=low)
    rows = low.astype(np.uint32).reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(rows)]
    return np.array(keys, np.uint64).view(np.int64)


# --- exact comparison -----------------------------------------------------------------------


class Apart:
    """Which of some sets belong together under links of at least ``similarity``.

    ``root`` holds the smallest index of each set's part; it may start with parts that are known. A set is
    compared with sets of other parts only. If it has a link, the other set has one of its rarest
    shingles as well, as many as may be missing and one more. If one of these is frequent, all other sets are
    counted by bits, else only the sets in the lists of these shingles are counted.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float, root: np.ndarray | None = None):
        self.n, self.similarity = len(sets), similarity
        self.root = np.arange(self.n) if root is None else root.copy()
        self.sizes = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(self.n), self.sizes)
        _, word, found = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        # words by rank: rare ones first
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(found, kind="stable")] = np.arange(len(found))
        word, found = rank[word], np.sort(found)
        self.lone = np.searchsorted(found, 2)  # words below have one set only
        self.frequent = np.searchsorted(found, FREQUENT)
        order = np.lexsort((word, owner))
        self.words = word[order]  # of one set after the other, rarest first
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        # lists of the words between lone and frequent
        rare = (word >= self.lone) & (word < self.frequent)
        by_word = np.lexsort((owner[rare], word[rare]))
        self.listed = owner[rare][by_word]
        self.list_starts = np.r_[0, np.cumsum(found[self.lone : self.frequent])]
        many = word >= self.frequent
        self.bits = np.zeros((self.n, -(-(len(found) - self.frequent) // 64) + 1), np.uint64)
        column = word[many] - self.frequent
        np.bitwise_or.at(self.bits, (owner[many], column // 64), np.uint64(1) << (column % 64).astype(np.uint64))

    def _lists(self, words: np.ndarray) -> np.ndarray:
        """The sets in the lists of the words, repeats included."""
        words = words[(words >= self.lone) & (words < self.frequent)] - self.lone
        if not len(words):
            return self.listed[:0]
        return np.concatenate([self.listed[self.list_starts[w] : self.list_starts[w + 1]] for w in words.tolist()])

    def join(self, queries: range) -> None:
        """Compare the sets of these indices with all others of other parts."""
        for i in queries:
            size = self.sizes[i]
            apart = self.root != self.root[i]
            apart &= np.minimum(self.sizes, size) >= self.similarity * np.maximum(self.sizes, size) - 1e-9
            if not apart.any():
                continue
            words = self.words[self.starts[i] : self.starts[i + 1]]
            missing = int(size - np.ceil(self.similarity * size - 1e-9))
            first = words[: missing + 1]
            if first[-1] >= self.frequent:
                others = np.flatnonzero(apart)
            else:
                others = np.unique(self._lists(first))
                others = others[apart[others]]
                if not len(others):
                    continue
            both = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
            both += np.bincount(self._lists(words), minlength=self.n)[others]
            near = others[both >= self.similarity * (self.sizes[others] + size - both) - 1e-9]
            if len(near):
                met = np.unique(np.r_[self.root[near], self.root[i]])
                self.root[np.isin(self.root, met)] = met[0]


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """For each set the smallest index of its part under links of at least ``similarity``."""
    found = Apart(sets, similarity)
    found.join(range(len(sets)))
    return found.root


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


# --- groups of candidates -------------------------------------------------------------------


def _cells(batches: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[tuple, Iterator[pd.DataFrame]]]:
    """The rows of each cell, as parts of batches; rows must arrive sorted by ``names``."""
    parts = (
        (tuple(found), part)
        for batch in batches
        for found, part in batch.groupby(names, sort=False)
    )
    now = next(parts, None)

    def cell(name: tuple) -> Iterator[pd.DataFrame]:
        nonlocal now
        while now is not None and now[0] == name:
            yield now[1]
            now = next(parts, None)

    while now is not None:
        name = now[0]
        yield name, cell(name)


def star_links(stars: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``, a > b: those of ``(digest, low)`` that are similar.

    A centre ``low`` of many sets gets several cells, each with the centre's own hashes in front.
    """
    sizes = stars.groupBy("low").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("cells"))
    salt = F.pmod(F.xxhash64("digest"), F.col("cells")).cast("int")
    members = stars.join(sizes, "low").select("low", salt.alias("cell"), "digest").join(sets, "digest")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    centres = sizes.select(F.col("low").alias("digest"), every.alias("cell")).join(sets, "digest")
    columns = ["low", "cell", "digest", "hashes"]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (low, _), parts in _cells(batches, ["low", "cell"]):
            centre, found = None, []
            for part in parts:
                for digest, hashes in zip(part["digest"], part["hashes"]):
                    own = np.frombuffer(hashes, np.uint64)
                    if centre is None:
                        centre = own
                    elif similar(own, centre, similarity):
                        found.append(digest)
            yield pd.DataFrame({"a": np.array(found, np.int64), "b": np.full(len(found), low, np.int64)})

    return (
        centres.withColumn("low", F.col("digest"))
        .select(*columns)
        .union(members.select(*columns))
        .repartition("low", "cell")
        .sortWithinPartitions("low", "cell", "digest")  # the centre is the smallest digest
        .mapInPandas(compare, "a bigint, b bigint")
    )


def group_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``, a > b: links that connect what is similar in each group of ``(digest, group, root)``.

    Sets of one ``root`` are known to belong together. A group's largest root is its main part; pairs
    inside it are not compared again, so each of its sets only meets the others. Groups are dealt into
    parts by hash, of at most about ``TILE`` sets and ``TILE_SHINGLES`` shingles, and every two parts that
    have to meet do so in one task, which returns links that span what it joined.
    """
    sized = members.join(sets.select("digest", F.length("hashes").alias("bytes")), "digest")
    roots = sized.groupBy("group", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    main = roots.groupBy("group").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    side = F.when(F.col("root") == F.col("main"), 0).otherwise(1).alias("side")
    parts = F.greatest(F.ceil(F.sum("n") / TILE), F.ceil(F.sum("bytes") / (8 * TILE_SHINGLES))).cast("int")
    sides = roots.join(main, "group").select("group", side, "n", "bytes")
    # parts 0 .. first - 1 are of the main part, first .. first + rest - 1 of the others
    shares = sides.groupBy("group").pivot("side", [0, 1]).agg(parts.alias("parts")).na.fill(0)
    shares = shares.select("group", F.col("0").alias("first"), F.col("1").alias("rest"))
    mine = F.when(F.col("root") == F.col("main"), F.pmod(F.xxhash64("digest"), F.col("first"))).otherwise(
        F.col("first") + F.pmod(F.xxhash64("digest"), F.col("rest"))
    )
    others = F.when(
        F.col("mine") < F.col("first"), F.sequence(F.col("first"), F.col("first") + F.col("rest") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("first") + F.col("rest") - 1))
    dealt = (
        members.join(main, "group")
        .join(shares.where("rest > 0"), "group")
        .withColumn("mine", mine.cast("int"))
        .withColumn("other", F.explode(others))
        .select("group", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "digest", "root", "mine")
        .join(sets, "digest")
        .select("group", "low", "high", "mine", "digest", "root", "hashes")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, parts in _cells(batches, ["group", "low", "high"]):
            rows = pd.concat(parts).sort_values(["mine", "digest"])
            digests = rows["digest"].to_numpy()
            own = np.unique(rows["root"].to_numpy(), return_index=True, return_inverse=True)
            start = own[1][own[2]]  # the first row of the same root
            found = Apart([np.frombuffer(h, np.uint64) for h in rows["hashes"]], similarity, start)
            # the rows of the lower part against all: pairs inside the higher one meet elsewhere
            found.join(range(int((rows["mine"] == rows["mine"].iloc[0]).sum())))
            new = np.flatnonzero(found.root != start)
            pairs = digests[new], digests[found.root[new]]
            yield pd.DataFrame({"a": np.maximum(*pairs), "b": np.minimum(*pairs)})

    return (
        dealt.repartition("group", "low", "high")
        .sortWithinPartitions("group", "low", "high")
        .mapInPandas(compare, "a bigint, b bigint")
    )


def close_prints(distinct: DataFrame, radius: int) -> DataFrame:
    """``(digest, band)``, the SimHash component of each set of ``(digest, bits)`` as one band more."""
    prints = written(distinct.select("bits").distinct(), "fingerprints")
    found = components(links(prints, radius)).select(F.col("a").alias("bits"), F.col("b").alias("root"))
    rooted = distinct.select("digest", "bits").join(found, "bits", "left")
    return rooted.select("digest", F.xxhash64(F.coalesce("root", "bits"), F.lit(BANDS)).alias("band"))


def parts_of(distinct: DataFrame, sets_of, similarity: float, radius: int = RADIUS) -> DataFrame:
    """``(a, b)``: every digest that belongs to a part with a smaller one, and the part's smallest.

    ``distinct`` has ``digest``, ``bits`` and ``bands``; ``sets_of(digests)`` gives ``(digest, hashes)`` of those
    asked for.
    """
    banded = distinct.select("digest", F.explode("bands").alias("band")).union(close_prints(distinct, radius))
    lowest = banded.groupBy("band").agg(F.min("digest").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(banded.join(lowest, "band").select("band", "digest", "low"), "shared-bands")
    sets = written(sets_of(shared.select("digest").distinct()), "sets")
    centred = shared.where("digest > low").groupBy("digest").agg(F.min("low").alias("low"))
    stars = written(star_links(centred, sets, similarity), "star-links")
    joined = components(stars)
    rooted = shared.join(joined.select(F.col("a").alias("digest"), F.col("b").alias("root")), "digest", "left")
    rooted = written(rooted.withColumn("root", F.coalesce("root", "digest")), "rooted")
    # bands whose sets are all in one part are done
    apart = rooted.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("two")).where("one < two")
    left = rooted.join(apart.select("band"), "band", "left_semi")
    edges = written(left.where("digest > low").select(F.col("digest").alias("a"), F.col("low").alias("b")).distinct(), "edges")
    groups = components(edges)
    grouped = groups.select(F.col("a").alias("digest"), F.col("b").alias("group"))
    grouped = grouped.union(groups.select("b", "b").distinct())  # a group's smallest member is one as well
    members = written(grouped.join(rooted.select("digest", "root").distinct(), "digest"), "members")
    return components(stars.union(group_links(members, sets, similarity)))


def one_of_each(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """The rows of ``df`` of which each stands for its group of near copies: the one with the smallest id.

    Of several rows with that id the one with the smallest text hash stays, of rows with the same id and text the
    one whose columns have the smallest hash; rows without an id come last. A missing text counts as empty;
    empty texts are copies of each other. All columns stay, whatever their names. An empty table
    gives an empty one. Sets that are equal are compared once.
    """
    key = unused(df, "_row_key")
    quoted = columns_of(df)
    text = text_of(F.col(f"`{text_col}`"))
    names = [F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), F.hex(F.xxhash64(text))]
    keyed = df.withColumn(key, F.concat_ws(":", *names))

    @F.pandas_udf("struct<digest:bigint,bits:bigint,bands:binary>")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        made = []
        for t in texts:
            hashes = shingle_hashes(t, shingle)
            own = as_set(hashes)
            made.append((xxhash.xxh64_intdigest(own.tobytes(), SEED), majority(hashes), bands(own).tobytes()))
        digests, bits = (np.array([m[i] for m in made], np.uint64).view(np.int64) for i in (0, 1))
        return pd.DataFrame({"digest": digests, "bits": bits, "bands": [m[2] for m in made]})

    @F.pandas_udf("binary")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingles(t, shingle).tobytes() for t in texts])

    importable(df.sparkSession)
    prints = keyed.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(key).alias("key"), sketch(text).alias("s"))
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    prints = written(prints.select("doc_id", "key", "s.digest", "s.bits", "s.bands"), "sketches")
    # sets are equal if texts repeat their shingles differently; the smallest fingerprint then stands for them
    firsts = prints.groupBy("digest").agg(
        F.min(ordered).alias("first"), F.min("bits").alias("bits"), F.max("bands").alias("bands")
    )
    # keys stay binary until they are needed one by one
    each = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(F.substring(F.col("bands"), i * 8 + 1, F.lit(8)), i)
    )
    distinct = written(firsts.select("digest", "first", "bits", each.alias("bands")), "distinct")

    def sets_of(digests: DataFrame) -> DataFrame:
        wanted = distinct.join(digests, "digest", "left_semi").select("digest", F.col("first.key").alias("key"))
        texts = keyed.select(F.col(key).alias("key"), text.alias("text")).join(wanted, "key")
        # rows that repeat whole share the key and the text
        return texts.select("digest", hashed("text").alias("hashes")).dropDuplicates(["digest"])

    found = parts_of(distinct.select("digest", "bits", "bands"), sets_of, similarity, radius)
    stays = (
        distinct.join(found.select(F.col("a").alias("digest"), F.col("b").alias("root")), "digest", "left")
        .groupBy(F.coalesce("root", "digest").alias("root"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias(key))
    )
    counts = prints.groupBy(F.col("key").alias(key)).agg(F.count(F.lit(1)).alias("n"))
    stays = written(stays.join(counts, key), "survivors")
    once = keyed.join(stays.where("n = 1").select(key), key, "left_semi").select(*quoted)
    # a key that occurs again: few rows, of which one stays
    whole = F.struct(*quoted)
    again = keyed.join(stays.where("n > 1").select(key), key, "left_semi")
    again = again.groupBy(key).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias(key + "row"))
    return once.union(again.select(f"`{key}row`.*"))
