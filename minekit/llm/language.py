"""Language identification by prediction by partial matching.

For every language a byte context tree of variable order holds how often each byte followed each
context of up to ``ORDER`` bytes. A byte that a context knows costs its share, one it does not
know costs an escape and then whatever the next shorter context asks, down to one of 256. The statistics
are frozen after learning, so the code length of a text is a sum over its positions and the
language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minekit.llm.common import columns_of, held_out, importable, text_of, unused

ORDER = 3
#: Documents per language that the trees are learned from at most: those with the smallest id hashes.
MAX_TRAIN = 400
#: Groups of input partitions in which ids are ranked before they are ranked together; no change of the result.
RANK_PARTS = 64
UNKNOWN = "und"
#: A text is none of the learned languages if it needs more than FAR times the bits per byte that the median
#: held-out text of its language needs, and SLACK bits, which a few unknown words cost.
FAR, SLACK = 2.5, 128
_SLICE = 1_000_000
_START = b"\0" * ORDER


def gram_codes(data: bytes) -> np.ndarray:
    """The ``ORDER + 1`` bytes that end at each position, as one number; a text begins after zeros."""
    b = np.frombuffer(_START + data, np.uint8).astype(np.uint32)
    return b[:-3] << np.uint32(24) | b[1:-2] << np.uint32(16) | b[2:-1] << np.uint32(8) | b[3:]


def _costs(codes: np.ndarray, counts: np.ndarray, lower: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Of one order and language: what known grams cost, and the known contexts with their escapes."""
    context = codes >> np.uint32(8)
    known, at = np.unique(context, return_inverse=True)
    total, different = np.bincount(at, counts), np.bincount(at)
    bits = np.log2(total + different)
    return np.log2(total + different)[at] - np.log2(counts), known, bits - np.log2(different)


@dataclass
class Trees:
    """Frozen statistics of all languages as tables of code lengths in bits.

    ``c1`` by the last two bytes; ``m2`` numbers contexts of two bytes and ``c2`` holds their rows
    of 256 bytes; ``m3`` numbers contexts of three bytes, ``m4`` the grams they know, and ``c4`` and ``e3``
    are the lengths of these grams and of the escapes. Number 0 means unknown everywhere.
    """

    languages: list[str]
    c1: np.ndarray
    m2: np.ndarray
    c2: np.ndarray
    m3: np.ndarray
    m4: np.ndarray
    c4: np.ndarray
    e3: np.ndarray

    def code_lengths(self, text: str) -> np.ndarray:
        """Bits that each language needs for the whole text."""
        total = np.zeros(len(self.languages))
        raw = text.encode()
        for at in range(0, len(raw), _SLICE):
            before = raw[max(at - ORDER, 0) : at]
            codes = gram_codes(before + raw[at : at + _SLICE])[len(before) :]
            total += self._bits(codes)
        return total

    def _bits(self, codes: np.ndarray) -> np.ndarray:
        last = (codes & np.uint32(0xFF)).astype(np.int64)
        short = self.m2[(codes >> np.uint32(8)) & np.uint32(0xFFFF)]
        long = self.m3[self.m2[codes >> np.uint32(16)] * 256 + ((codes >> np.uint32(8)) & np.uint32(0xFF))]
        gram = self.m4[long.astype(np.int64) * 256 + last]
        total = self.c4[gram[gram > 0]].sum(0, dtype=np.float64)
        rest = gram == 0
        long, short, last, codes = long[rest], short[rest].astype(np.int64), last[rest], codes[rest]
        total += self.e3[long].sum(0, dtype=np.float64)
        known = short > 0
        total += self.c2[short[known] * 256 + last[known]].sum(0, dtype=np.float64)
        return total + self.c1[codes[~known] & np.uint32(0xFFFF)].sum(0, dtype=np.float64)


def _share(codes: np.ndarray, counts: np.ndarray, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the grams cut to fewer bytes."""
    cut, at = np.unique(codes & np.uint32(mask), return_inverse=True)
    return cut, np.bincount(at, counts)


def build(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> Trees | None:
    """Tables from ``language -> (codes, counts)``, codes of four bytes; None without a language."""
    languages = sorted(grams)
    if not languages:
        return None
    n = len(languages)
    c1 = np.empty((65536, n), np.float32)
    every = np.unique(np.concatenate([codes for codes, _ in grams.values()]))
    contexts2 = np.unique(every >> np.uint32(8) & np.uint32(0xFFFF))
    together = np.concatenate([codes >> np.uint32(8) for codes, _ in grams.values()])
    contexts3 = np.unique(together)
    m2 = np.zeros(65536, np.int64)
    # contexts of three bytes are found through their first two, so these are numbered as well
    pairs = np.union1d(contexts2, contexts3 >> np.uint32(8))
    m2[pairs] = np.arange(1, len(pairs) + 1)
    c2 = np.empty(((len(pairs) + 1) * 256, n), np.float32)
    m3 = np.zeros((len(pairs) + 1) * 256, np.int32)
    m3[m2[contexts3 >> np.uint32(8)] * 256 + (contexts3 & np.uint32(0xFF))] = np.arange(1, len(contexts3) + 1)

    def numbered(codes: np.ndarray) -> np.ndarray:
        context = codes >> np.uint32(8)
        return m3[m2[context >> np.uint32(8)] * 256 + (context & np.uint32(0xFF))].astype(np.int64)

    m4 = np.zeros((len(contexts3) + 1) * 256, np.int32)
    m4[numbered(every) * 256 + (every & np.uint32(0xFF))] = np.arange(1, len(every) + 1)
    c4 = np.zeros((len(every) + 1, n), np.float32)
    e3 = np.zeros((len(contexts3) + 1, n), np.float32)
    for k, language in enumerate(languages):
        codes, counts = grams[language]
        # order 0 escapes to one of 256, order 1 to order 0
        cut, many = _share(codes, counts, 0xFF)
        cost, _, escape = _costs(cut, many, c1)
        zero = np.full(256, escape[0] + 8.0)
        zero[cut] = cost
        cut, many = _share(codes, counts, 0xFFFF)
        cost, known, escape = _costs(cut, many, c1)
        one = np.tile(zero, (256, 1))
        one[known] += escape[:, None]
        one = one.ravel()
        one[cut] = cost
        c1[:, k] = one
        cut, many = _share(codes, counts, 0xFFFFFF)
        cost, known, escape = _costs(cut, many, c1)
        two = np.empty((len(pairs) + 1, 256))
        two[0] = 8.0
        two[1:] = one.reshape(256, 256)[pairs & np.uint32(0xFF)]
        own = m2[known]
        two[own[own > 0]] += escape[own > 0, None]
        two = two.ravel()
        place = m2[cut >> np.uint32(8)]
        two[place[place > 0] * 256 + (cut[place > 0] & np.uint32(0xFF))] = cost[place > 0]
        c2[:, k] = two
        cost, known, escape = _costs(codes, counts, c2)
        number = m3[m2[known >> np.uint32(8)] * 256 + (known & np.uint32(0xFF))]
        e3[number[number > 0], k] = escape[number > 0]
        # grams of other languages: escape, then the shorter context
        low = m2[every >> np.uint32(8) & np.uint32(0xFFFF)]
        c4[1:, k] = e3[numbered(every), k] + two[low * 256 + (every & np.uint32(0xFF))]
        place = m4[numbered(codes) * 256 + (codes & np.uint32(0xFF))]
        c4[place[place > 0], k] = cost[place > 0]
    return Trees(languages, c1, m2, c2, m3, m4, c4, e3)


def _taught(df: DataFrame, id_col: str, text_col: str, lang_col: str, held: bool) -> DataFrame:
    """``(id, lang, text)`` of the rows with text and language, of the held-out ids or of the others."""
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.where((held_out("id") == held) & F.col("lang").isNotNull() & F.col("text").isNotNull())


def _chosen(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_train: int) -> DataFrame:
    """``(lang, text)`` of at most ``max_train`` ids of each language that are not held out."""
    fit = _taught(df, id_col, text_col, lang_col, held=False)
    order = (F.xxhash64("id"), "id")
    ids = fit.select("id", "lang", (F.spark_partition_id() % RANK_PARTS).alias("part"))
    # each input partition gives max_train ids a language at most; these are ranked within groups of input
    # partitions first. The first ids of all are among the first of their groups, however rows are dealt
    in_part = Window.partitionBy("lang", "part").orderBy(*order)
    first = ids.withColumn("at", F.row_number().over(in_part)).where(F.col("at") <= max_train).drop("at")
    by_hash = Window.partitionBy("lang").orderBy(*order)
    chosen = first.withColumn("at", F.row_number().over(by_hash)).where(F.col("at") <= max_train)
    # at most max_train ids a language: the bound of this broadcast
    return fit.join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"]).select("lang", "text")


def train(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_train: int = MAX_TRAIN,
) -> Trees | None:
    """Trees from at most ``max_train`` whole documents of each language that are not held out.

    Ids are ranked without their texts; executors count the grams of the chosen texts, Spark adds
    the counts up, and only the sums come to the driver. Documents without text, language or id
    teach nothing.
    """
    texts = _chosen(df, id_col, text_col, lang_col, max_train)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                codes = [gram_codes(t.encode()) for t in group["text"]]
                code, many = np.unique(np.concatenate(codes), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": many})

    importable(df.sparkSession)
    summed = (
        texts.mapInPandas(count, "lang string, code bigint, n bigint")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    return build(
        {
            lang: (g["code"].to_numpy().astype(np.uint32), g["n"].to_numpy().astype(np.float64))
            for lang, g in summed.sort_values("code").groupby("lang")
        }
    )


def predict(df: DataFrame, trees: Trees | None, text_col: str = "text", name: str = "language") -> DataFrame:
    """``df`` with a struct ``name`` of ``lang_pred``, ``score`` and ``bits`` per byte; no shuffle.

    The score is the probability of the language among the learned ones, all alike likely before.
    A missing text, one without a letter, and any text if nothing was learned are ``und``, score 0.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("struct<lang_pred:string,score:double,bits:double>")
    def best(texts: pd.Series) -> pd.DataFrame:
        trees, out = shared.value, []
        for text in texts:
            if trees is None or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            bits = trees.code_lengths(text)
            k = int(bits.argmin())
            share = 1 / np.exp2(np.minimum(bits[k] - bits, 0)).sum()
            out.append((trees.languages[k], float(share), float(bits[k] / len(text.encode()))))
        return pd.DataFrame(out, columns=["lang_pred", "score", "bits"])

    importable(spark)
    return df.withColumn(name, best(text_of(text_col)))


def usual_bits(
    df: DataFrame,
    trees: Trees,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> dict[str, float]:
    """Bits per byte of the median text of each predicted language, from all held-out texts, which train never sees.

    A language that none of them has is left out.
    """
    asked = _taught(df, id_col, text_col, lang_col, held=True).where(F.col("id").isNotNull()).select("text")
    told = predict(asked, trees, "text").select("language.*")
    # the middle by rank: sorted rows go to disk if they are many, the counts of a median stay in memory
    of_lang = Window.partitionBy("lang_pred")
    at, n = F.row_number().over(of_lang.orderBy("bits")), F.count(F.lit(1)).over(of_lang)
    ranked = told.select("lang_pred", "bits", at.alias("at"), n.alias("n"))
    middle = ranked.where((F.col("at") * 2 >= F.col("n")) & (F.col("at") * 2 <= F.col("n") + 2))
    medians = middle.groupBy("lang_pred").agg(F.avg("bits").alias("m"))
    # texts without a language go here: a filter would be pushed below the prediction and ask for it twice, and a
    # task then holds two Python workers, both of which stay for the stages behind
    return {r.lang_pred: r.m for r in medians.collect() if r.lang_pred != UNKNOWN}


def known(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text is in a learned language, all columns as they are.

    Out go texts without a letter and those beyond FAR and SLACK, for a language without held-out
    texts by the largest of the others. If nothing can be learned, or nothing held out, letters decide.
    """
    letters = df.where(text_of(text_col).rlike(r"\p{L}"))
    trees = train(df, id_col, text_col, lang_col)
    usual = usual_bits(df, trees, id_col, text_col, lang_col) if trees else {}
    if not usual:
        return letters
    name = unused(df, "_language")
    told = predict(df, trees, text_col, name=name)
    pred, bits = F.col(f"{name}.lang_pred"), F.col(f"{name}.bits")
    rate = F.lit(max(usual.values()))
    for lang, median in usual.items():
        rate = F.when(pred == lang, F.lit(median)).otherwise(rate)
    size = F.octet_length(text_of(text_col))
    near = bits * size <= FAR * rate * size + SLACK
    return told.where((pred != UNKNOWN) & near).select(*columns_of(df))


def identify(df: DataFrame, trees: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score, bits)`` of every row; repeated rows repeat their result."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, trees).select("doc_id", held_out("doc_id").alias("held_out"), "language.*")
