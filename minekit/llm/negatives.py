"""Hard negatives by shared candidate lists of anchor clusters, walked until a bound certifies the end.

Anchors are clustered by direction. For each cluster all candidates are put in order once, by an upper
bound on their inner product with any unit vector of the cluster: |v| cos(max(0, angle to the centroid - widest
angle of the cluster)). Every anchor of the cluster walks that list from the top and stops when the bound
of what is left, times its own length, is below what it holds already or asks for. The bound only decides
when to stop, so results are exact; where angles say little the walk is long, never wrong.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minekit.llm.common import importable, written

#: Clusters of anchors, at every size: each has its own list of all candidates. Large ones walk in blocks.
CLUSTERS = 8
#: Anchors from which centroids and band limits are learned, a bounded sample: any of them give exact results.
TRAIN = 4096
#: Anchors that walk together in one task, and candidates in the stretch of a list that one task walks.
BLOCK, STRETCH = 1024, 32_768
#: Lists are walked in bands that end at these shares of them; between bands finished anchors are taken out.
BANDS = (0.125, 1.0)
#: Candidates compared at a time.
_STEP = 1024
#: Allowance for rounding, on angles and on whole-number scores.
_ANGLE, _SLACK = 1e-6, 1.0


# --- rows -----------------------------------------------------------------------------------


def whole_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0
) -> DataFrame:
    """``(id, label, v, norm)``: components times ``scale``, rounded down to whole numbers.

    Rows without an id, a label or a vector, and those with a missing or non-finite component, take no
    part. Shorter vectors count as filled up with zeros. Of rows with one id the first by label, then vector
    stays, so rows that repeat count once.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    v = F.transform(x, lambda e: F.floor(e * F.lit(scale)).cast("bigint"))
    row = F.struct(F.col(label_col).cast("bigint").alias("label"), v.alias("v")).alias("row")
    square = F.aggregate("row.v", F.lit(0.0), lambda total, e: total + e.cast("double") * e)
    return (
        df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(sound, F.lit(False)))
        .select(F.col(id_col).cast("bigint").alias("id"), row)
        .groupBy("id")
        .agg(F.min("row").alias("row"))
        .select("id", "row.label", "row.v", F.sqrt(square).alias("norm"))
    )


def matrix(vectors: pd.Series, width: int, kind: type) -> np.ndarray:
    """The vectors as rows, short ones filled up with zeros."""
    out = np.zeros((len(vectors), width), kind)
    if len(vectors) and all(len(v) == width for v in vectors):
        out[:] = np.stack(vectors.to_numpy())
    else:
        for row, v in zip(out, vectors):
            row[: len(v)] = v
    return out


# --- clusters and bounds --------------------------------------------------------------------


def centroids(units: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` unit vectors, by spherical k-means from the first rows on."""
    found = units[:k].copy()
    for _ in range(rounds):
        nearest = np.argmax(units @ found.T, axis=1)
        total = np.zeros_like(found)
        np.add.at(total, nearest, units)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        found = np.where(length > 0, total / np.maximum(length, 1e-300), found)
    return found


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    rows = rows.astype(float)
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1.0)


def angles(units: np.ndarray, to: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ to.T, -1.0, 1.0))


def bounds(rows: np.ndarray, to: np.ndarray, widest: np.ndarray) -> np.ndarray:
    """By row and cluster: what no inner product with a unit vector of the cluster exceeds."""
    gap = np.maximum(angles(unit(rows), to) - widest - _ANGLE, 0.0)
    return np.linalg.norm(rows.astype(float), axis=1, keepdims=True) * np.cos(gap)


@dataclass(frozen=True)
class Lists:
    """The clusters of the anchors, and where the bands of their lists end."""

    to: np.ndarray  # centroids
    widest: np.ndarray  # angle of each cluster
    blocks: np.ndarray  # of its anchors
    ends: np.ndarray  # by cluster and band: the lowest bound inside
    rows: int
    width: int
    exact: bool  # whether all products and sums are exact as doubles


def clustered(anchors: DataFrame, rows: DataFrame) -> tuple[DataFrame, Lists]:
    """``anchors`` with ``cluster`` and ``block``, written once, and the lists they walk.

    To the driver go ``TRAIN`` anchors and a few numbers for each of the ``CLUSTERS``.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width"), F.max("norm").alias("norm")).first()
    width = facts["width"] or 0
    sample = anchors.select("v", F.xxhash64("id").alias("at")).orderBy("at").limit(TRAIN).toPandas()["v"]
    learned = matrix(sample, width, float)
    directions = unit(learned)[np.linalg.norm(learned, axis=1) > 0]
    to = centroids(directions, CLUSTERS) if len(directions) else np.zeros((1, width))

    @F.pandas_udf("struct<cluster:int,angle:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        units = unit(matrix(vectors, width, float))
        apart = angles(units, to)
        apart[~units.any(axis=1)] = 0.0  # no direction, no inner product but zero
        best = np.argmin(apart, axis=1)
        return pd.DataFrame({"cluster": best.astype(np.int32), "angle": apart[np.arange(len(best)), best]})

    importable(rows.sparkSession)
    placed = written(anchors.withColumn("at", nearest("v")).select(*anchors.columns, "at.cluster", "at.angle"), "anchors")
    widest, blocks = np.zeros(len(to)), np.zeros(len(to), np.int64)
    for r in placed.groupBy("cluster").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).collect():
        widest[r["cluster"]], blocks[r["cluster"]] = r["widest"], math.ceil(r["n"] / BLOCK)
    seen = bounds(learned, to, widest)
    ends = np.full((len(to), len(BANDS)), -np.inf)
    if len(learned):
        ends[:, :-1] = np.quantile(seen, [1 - share for share in BANDS[:-1]], axis=0).T
    lists = Lists(to, widest, blocks, ends, facts["n"], width, (facts["norm"] or 0.0) ** 2 < 2.0**53)
    of_cluster = F.element_at(F.lit([int(max(n, 1)) for n in blocks]), F.col("cluster") + 1)
    block = F.pmod(F.xxhash64("id"), of_cluster).cast("int")
    return placed.withColumn("block", block).drop("angle"), lists


# --- the walk -------------------------------------------------------------------------------


class Walk:
    """The anchors of one block on their way down one stretch of their cluster's list.

    An anchor asks for the ``k`` best of the candidates with its own label, or with another, whose scores lie
    from ``low`` to ``high``; it may ask several times, under different keys. Of equal scores the smaller
    id is better.
    """

    def __init__(self, rows: pd.DataFrame, same: bool, k: int, width: int, kind: type):
        self.same, self.k, self.width, self.kind = same, k, width, kind
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.norms, self.vectors = rows["norm"].to_numpy(), matrix(rows["v"], width, kind)
        asked = [(i, a["key"], a["low"], a["high"], a["floor"]) for i, asks in enumerate(rows["asks"]) for a in asks]
        self.anchor = np.array([a[0] for a in asked], int)
        self.key = np.array([a[1] for a in asked], np.int64)
        self.low, self.high, floor = (np.array([a[c] for a in asked], float) for c in (2, 3, 4))
        self.need = np.fmax(self.low, floor)  # the score that still gets in
        self.held = (np.zeros(0, int), np.zeros(0, np.float64 if kind is float else np.int64), np.zeros(0, np.int64))
        self.over = False

    def offer(self, rows: pd.DataFrame) -> None:
        """Compare with the next candidates of the list, in its order."""
        for i in range(0, len(rows), _STEP):
            if not self.over:
                self._step(rows.iloc[i : i + _STEP])

    def _step(self, rows: pd.DataFrame) -> None:
        going = np.flatnonzero(self.norms[self.anchor] * rows["bound"].iloc[0] + _SLACK >= self.need)
        if not len(going):
            self.over = True  # certified: nothing below can get in
            return
        who, at = np.unique(self.anchor[going], return_inverse=True)
        scores = self.vectors[who] @ matrix(rows["v"], self.width, self.kind).T
        ids = rows["id"].to_numpy()
        fits = self.labels[who][:, None] == rows["label"].to_numpy()[None, :]
        if not self.same:
            fits = ~fits
        fits &= self.ids[who][:, None] != ids[None, :]
        asked = scores[at]
        fits = fits[at] & (asked >= self.need[going][:, None]) & (asked <= self.high[going][:, None])
        if len(ids) > self.k:  # of one step only the best k and their equals
            shown = np.where(fits, asked, -np.inf)
            fits &= shown >= np.partition(shown, len(ids) - self.k, axis=1)[:, len(ids) - self.k][:, None]
        ask, candidate = np.nonzero(fits)
        if not len(ask):
            return
        new = going[ask], asked[ask, candidate], ids[candidate]
        ask, score, other = (np.concatenate(pair) for pair in zip(self.held, new))
        order = np.lexsort((other, -score, ask))
        ask, score, other = ask[order], score[order], other[order]
        first = np.r_[True, ask[1:] != ask[:-1]]
        rank = np.arange(len(ask)) - np.maximum.accumulate(np.where(first, np.arange(len(ask)), 0))
        stays = rank < self.k
        full = rank == self.k - 1
        self.need[ask[full]] = np.maximum(self.need[ask[full]], score[full])
        self.held = ask[stays], score[stays], other[stays]

    def out(self) -> pd.DataFrame:
        ask, score, other = self.held
        return pd.DataFrame(
            {
                "anchor": self.ids[self.anchor[ask]],
                "key": self.key[ask],
                "other": other,
                "score": score.astype(np.int64),
            }
        )


def _in_band(lists: Lists, alive: np.ndarray, start: np.ndarray, end: np.ndarray) -> Column:
    """``(cluster, bound)`` of a vector ``v`` in every cluster that goes on and has it in this band."""

    @F.pandas_udf("array<double>")
    def bound(vectors: pd.Series) -> pd.Series:
        values = bounds(matrix(vectors, lists.width, float), lists.to, lists.widest)
        values[:, ~alive] = np.nan
        values[(values >= start) | (values < end)] = np.nan
        return pd.Series(list(values))

    placed = F.transform(bound("v"), lambda x, i: F.struct(i.alias("cluster"), x.alias("bound")))
    return F.filter(placed, lambda e: e["bound"] < float("inf"))  # neither null nor NaN


_ASKS = "array<struct<key:bigint,low:double,high:double,floor:double>>"


def walked(anchors: DataFrame, rows: DataFrame, lists: Lists, same: bool, k: int, name: str) -> DataFrame:
    """``(anchor, key, other, score, rank)``: the ``k`` best for each key that an anchor ``asks`` for.

    A band of the lists is walked at a time. A task walks one stretch of a list, a share of the band by hash in
    the list's order, with one block of the cluster's anchors; it streams its candidates and holds the
    anchors and their best. Then what an anchor holds over all stretches decides whether it goes on.
    """
    place = Window.partitionBy("anchor", "key").orderBy(F.desc("score"), "other")
    top = lambda df: df.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    spark = rows.sparkSession
    importable(spark)
    alive = lists.blocks > 0
    going, found, start = anchors, None, np.full(len(lists.to), np.inf)
    kind = float if lists.exact else np.int64
    width = lists.width
    for band, share in enumerate(BANDS):
        end = lists.ends[:, band]
        stretches = max(1, math.ceil(lists.rows * (share - (BANDS[band - 1] if band else 0.0)) / STRETCH))

        placed = F.inline(_in_band(lists, alive, start, end)).alias("cluster", "bound")
        blocks = F.element_at(F.lit([int(max(n, 1)) for n in lists.blocks]), F.col("cluster") + 1)
        listed = (
            rows.select("id", "label", "v", placed)
            .withColumn("block", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
            .withColumn("stretch", F.pmod(F.xxhash64("id"), F.lit(stretches)).cast("int"))
            .withColumns({"norm": F.lit(None).cast("double"), "asks": F.lit(None).cast(_ASKS)})
        )
        asking = going.withColumn("stretch", F.explode(F.sequence(F.lit(0), F.lit(stretches - 1)))).withColumn(
            "bound", F.lit(float("inf"))
        )
        columns = ["cluster", "block", "stretch", "bound", "id", "label", "v", "norm", "asks"]
        cells = asking.select(*columns).unionByName(listed.select(*columns))

        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cell, waiting, going = None, [], None
            for batch in batches:
                names = batch[["cluster", "block", "stretch"]].to_numpy()
                if not len(names):
                    continue
                starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
                for a, b in zip(starts, [*starts[1:], len(names)]):
                    if cell != tuple(names[a]):
                        if going is not None:
                            yield going.out()
                        cell, waiting, going = tuple(names[a]), [], None
                    part = batch.iloc[a:b]
                    anchors = part["asks"].notna().to_numpy()
                    if anchors.any():  # they come first
                        waiting.append(part[anchors])
                    if not anchors.all() and (going is not None or waiting):
                        if going is None:
                            going = Walk(pd.concat(waiting), same, k, width, kind)
                        going.offer(part[~anchors])
            if going is not None:
                yield going.out()

        step = (
            cells.repartition("cluster", "block", "stretch")
            .sortWithinPartitions("cluster", "block", "stretch", F.col("asks").isNull(), F.desc("bound"), "id")
            .mapInPandas(walk, "anchor bigint, key bigint, other bigint, score bigint")
        )
        both = step if found is None else found.select("anchor", "key", "other", "score").unionByName(step)
        found = written(top(both), f"{name}-{band}")
        if band == len(BANDS) - 1:
            break
        # who goes on: asks that the rest of the list could still serve
        kth = found.where(F.col("rank") == k).select(F.col("anchor").alias("id"), "key", F.col("score").alias("kth"))
        left = F.element_at(F.lit([float(b) for b in end]), F.col("cluster") + 1)
        needed = F.greatest("ask.low", F.col("kth").cast("double"))  # of what is not null
        ask = F.struct("ask.key", "ask.low", "ask.high", needed.alias("floor"))
        plain = [c for c in going.columns if c != "asks"]
        going = written(
            going.select(*plain, F.explode("asks").alias("ask"))
            .select(*plain, "ask", F.col("ask.key").alias("key"))
            .join(kth, ["id", "key"], "left")
            .where(F.col("norm") * left + _SLACK >= needed)
            .groupBy("id")
            .agg(*[F.first(c).alias(c) for c in plain if c != "id"], F.collect_list(ask).alias("asks")),
            f"{name}-going-{band}",
        )
        alive = np.zeros(len(lists.to), bool)
        alive[[r["cluster"] for r in going.select("cluster").distinct().collect()]] = True
        if not alive.any():
            break
        start = end
    return found


# --- the operator ---------------------------------------------------------------------------


def mine(
    rows: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
) -> DataFrame:
    """Hard negatives of the anchors among ``rows``, which are ``(id, label, v, norm)`` with whole ``v``.

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its first ``positives``
    other rows of the same label, by inner product, then id. For each of them the first ``negatives`` rows of
    another label come back whose score is from ``least`` to ``most`` percent of the positive's, as
    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``; a positive without
    such rows has none. Anchors without positives and empty tables give no rows. Scores are exact up to
    sums of 2**53, computed as doubles, and as 64-bit whole numbers beyond.
    """
    rows = written(rows, "vectors")
    anchors, lists = clustered(rows.where(F.col("id") % every == 0), rows)
    everything = F.struct(
        F.lit(0).cast("bigint").alias("key"),
        F.lit(float("-inf")).alias("low"),
        F.lit(float("inf")).alias("high"),
        F.lit(None).cast("double").alias("floor"),
    )
    near = walked(anchors.withColumn("asks", F.array(everything)), rows, lists, True, positives, "positives")
    score = F.col("score")
    window = F.struct(
        score.alias("key"),
        F.ceil(score * least / 100).cast("double").alias("low"),
        F.floor(score * most / 100).cast("double").alias("high"),
        F.lit(None).cast("double").alias("floor"),
    )
    asks = near.where("score >= 0").groupBy(F.col("anchor").alias("id")).agg(F.collect_set(window).alias("asks"))
    far = walked(anchors.join(asks, "id"), rows, lists, False, negatives, "negatives")
    return near.select(
        F.col("anchor").alias("anchor_id"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(
        far.select(
            F.col("anchor").alias("anchor_id"),
            F.col("key").alias("positive_score"),
            "rank",
            F.col("other").alias("negative_id"),
            F.col("score").alias("negative_score"),
        ),
        ["anchor_id", "positive_score"],
    ).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def moved_labels(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", every: int = 7) -> DataFrame:
    """The query's contract: where the id is divisible by ``every``, the label moves on by one, modulo ten."""
    label = F.col(label_col)
    return df.withColumn(label_col, F.when(F.col(id_col) % every == 0, (label + 1) % 10).otherwise(label))
