"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages and has one label; which passage earned it is not known. Each
passage is encoded from what its bytes and words look like, gated attention weighs the passages,
and the weighted mean of the encodings is scored. Encoder, attention and scorer are learned
together from document labels by gradient descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minekit.llm.common import held_out, importable, text_of

#: Labelled documents that the model is fitted on at most: those with the smallest id hashes.
MAX_TRAIN = 4000
PASSAGE_WORDS = 48
#: Bytes of a text that are featurised in one piece; longer texts are cut between words.
SLICE = 1_000_000
_HASHED = 64
_HIDDEN, _ATTENTION = 24, 12

# Classes of ASCII bytes whose shares describe a passage.
_CLASSES = ("0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".", ",", "!?", "|", "#$%&*<>=~^", "\"'()[]{}-:;/\\@_+`", " \t\n\v\f\r")
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)  # bytes of other scripts: the last class
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[list(_chars.encode())] = _k
_BLANK = len(_CLASSES) - 1
_N_CLASSES = len(_CLASSES) + 1
FEATURES = _N_CLASSES + 6 + _HASHED
_POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def _passages(data: np.ndarray) -> np.ndarray:
    """Feature rows of the passages of a slice of UTF-8 bytes; one row at least."""
    kinds = _CLASS_OF[data]
    blank = kinds == _BLANK
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    if not len(starts):
        return np.zeros((1, FEATURES), np.float32)
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    size = ends - starts
    first = np.arange(0, len(starts), PASSAGE_WORDS)
    n = len(first)
    per = np.diff(np.r_[first, len(starts)])
    passage_of_word = np.repeat(np.arange(n), per)
    cuts = np.r_[0, starts[first[1:]], len(data)]
    lengths = np.diff(cuts)
    passage = np.repeat(np.arange(n), lengths)
    counts = np.bincount(passage * _N_CLASSES + kinds, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)

    # word hashes: bytes times powers of their place in the word
    word = np.repeat(np.arange(len(starts)), size)
    inside = np.flatnonzero(~blank)
    place = np.minimum(inside - starts[word], 63)
    hashed = np.add.reduceat((data[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place], np.r_[0, np.cumsum(size)[:-1]])
    pair = hashed * np.uint64(3) + np.r_[hashed[1:], np.uint64(0)]
    _, again, seen = np.unique(pair, return_inverse=True, return_counts=True)
    repeated = np.add.reduceat((seen[again] > 1).astype(np.float64), first)
    bucket = (hashed >> np.uint64(40)).astype(np.int64) % _HASHED
    words = np.bincount(passage_of_word * _HASHED + bucket, minlength=n * _HASHED).reshape(n, _HASHED)

    capital = (kinds[starts] == 1).astype(np.float64)
    odd_end = (kinds[ends - 1] >= 5) & (kinds[ends - 1] < _BLANK)
    shape = np.stack(
        [
            np.log1p(per),
            np.add.reduceat(size, first) / per,
            repeated / per,
            np.add.reduceat(capital, first) / per,
            np.add.reduceat(odd_end.astype(np.float64), first) / per,
            np.bincount(passage[data == 10], minlength=n) / per,
        ],
        axis=1,
    )
    return np.hstack([counts / lengths[:, None], shape, words / per[:, None]]).astype(np.float32)


def bag(text: str | None) -> np.ndarray:
    """Feature rows of all passages of a whole text; a text without words is one empty passage."""
    raw = (text or "").encode()
    rows, at = [], 0
    while True:
        end = at + SLICE
        if end < len(raw):
            cut = raw.rfind(b" ", at, end)
            end = cut if cut > at else end
        rows.append(_passages(np.frombuffer(raw[at:end], np.uint8)) if end > at and at < len(raw) else np.zeros((1, FEATURES), np.float32))
        at = end
        if at >= len(raw):
            return np.concatenate(rows)


@dataclass
class Model:
    """Learned weights; without any labelled document every score is one half."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] | None

    def attention(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Attention of every passage and score of every bag; ``starts`` are the bags' first rows."""
        if self.weights is None:
            return np.ones(len(x)), np.full(len(starts), 0.5)
        _, _, _, attention, _, score = _forward(self.weights, (x - self.mean) / self.scale, starts)
        return attention, score

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags:
            return np.zeros(0)
        starts = np.r_[0, np.cumsum([len(b) for b in bags])[:-1]]
        return self.attention(np.concatenate(bags), starts)[1]


def _forward(w: dict, x: np.ndarray, starts: np.ndarray) -> tuple:
    per = np.diff(np.r_[starts, len(x)])
    encoded = np.tanh(x @ w["encode"] + w["encode0"])
    value, gate = np.tanh(encoded @ w["value"]), 1 / (1 + np.exp(-(encoded @ w["gate"])))
    raw = (value * gate) @ w["attend"]
    raised = np.exp(raw - np.repeat(np.maximum.reduceat(raw, starts), per))
    attention = raised / np.repeat(np.add.reduceat(raised, starts), per)
    pooled = np.add.reduceat(attention[:, None] * encoded, starts)
    logit = pooled @ w["score"] + w["score0"][0]
    return encoded, value, gate, attention, pooled, 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _gradient(w: dict, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
    per = np.diff(np.r_[starts, len(x)])
    encoded, value, gate, attention, pooled, p = _forward(w, x, starts)
    d_logit = (p - y) / len(y)
    d_pooled = np.repeat(d_logit[:, None] * w["score"], per, axis=0)
    d_attention = (encoded * d_pooled).sum(1)
    mean = np.add.reduceat(attention * d_attention, starts)
    d_raw = attention * (d_attention - np.repeat(mean, per))
    d_both = d_raw[:, None] * w["attend"]
    d_value, d_gate = d_both * gate * (1 - value**2), d_both * value * gate * (1 - gate)
    d_encoded = attention[:, None] * d_pooled + d_value @ w["value"].T + d_gate @ w["gate"].T
    d_in = d_encoded * (1 - encoded**2)
    return {
        "encode": x.T @ d_in,
        "encode0": d_in.sum(0),
        "value": encoded.T @ d_value,
        "gate": encoded.T @ d_gate,
        "attend": (value * gate).T @ d_raw,
        "score": pooled.T @ d_logit,
        "score0": np.array([d_logit.sum()]),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128) -> Model:
    """Learn from bags of passages and their 0/1 labels; the same input gives the same model."""
    if not bags or len(set(labels.tolist())) < 2:
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(0), every.std(0) + 0.05
    rng = np.random.default_rng(11)
    normal = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {
        "encode": normal(FEATURES, _HIDDEN),
        "encode0": np.zeros(_HIDDEN),
        "value": normal(_HIDDEN, _ATTENTION),
        "gate": normal(_HIDDEN, _ATTENTION),
        "attend": normal(_ATTENTION),
        "score": normal(_HIDDEN),
        "score0": np.zeros(1),
    }
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    inputs = [(b - mean) / scale for b in bags]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x = np.concatenate([inputs[i] for i in chosen])
            starts = np.r_[0, np.cumsum([len(inputs[i]) for i in chosen])[:-1]]
            step += 1
            for k, g in _gradient(w, x, starts, labels[chosen].astype(np.float64)).items():
                g = g + 1e-4 * w[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                rate = 0.01 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                w[k] = w[k] - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return Model(mean, scale, w)


def train(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
) -> Model:
    """Fit on at most ``max_train`` labelled documents whose ids are not held out.

    An id with several labels counts with the smallest, one without a label or an id not at all. Executors
    turn the chosen whole texts into passage features; only these come to the driver.
    """
    known = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(~held_out("id") & F.col("label").isin(0, 1))
        .groupBy("id")
        .agg(F.min("label").alias("label"))
    )
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(max_train)
    texts = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    # at most max_train ids: the bound of this broadcast
    rows = texts.join(F.broadcast(chosen), "id")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data = [bag(t).tobytes() for t in batch["text"]]
            yield pd.DataFrame({"id": batch["id"].astype(str), "label": batch["label"], "bag": data})

    importable(df.sparkSession)
    # rows with the same id could be many: still no more than max_train documents
    got = rows.mapInPandas(encode, "id string, label int, bag binary").limit(max_train).collect()
    got.sort(key=lambda r: (r["id"], bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES) for r in got]
    return fit(bags, np.array([r["label"] for r in got]))


def score(df: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``df`` with the score of every whole text, 0 to 1, in place and without a shuffle.

    A missing text scores like an empty one. A column called ``name`` is replaced.
    """

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        out, bags, size = [], [], 0
        for text in texts:
            bags.append(bag(text))
            size += len(bags[-1])
            if size > 20_000:  # passages scored at a time
                out.append(model.scores(bags))
                bags, size = [], 0
        return pd.Series(np.concatenate([*out, model.scores(bags)]))

    importable(df.sparkSession)
    return df.withColumn(name, scores(text_of(text_col)))


def classify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row; repeated rows repeat their result."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(rows, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
