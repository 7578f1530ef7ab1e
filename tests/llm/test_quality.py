import zlib
from pathlib import Path

import fixtures
import numpy as np
import pytest

from minekit.llm import quality
from minekit.llm.common import held_out

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    return docs, labels, quality.train(docs, labels)


def test_held_out_accuracy(fitted):
    docs, labels, model = fitted
    got = quality.classify(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 80
    right = sum(r.predicted == r.quality for r in got) / len(got)
    bad = [r.score for r in got if r.quality == 0]
    good = [r.score for r in got if r.quality == 1]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert right >= 0.95 and auc >= 0.97
    assert all(r.predicted == int(r.score >= 0.5) for r in got)


def test_held_out_ids(spark):
    ids = [*range(50), None]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    for r in df.select("doc_id", held_out("doc_id").alias("h")).collect():
        assert r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_attention_finds_the_bad_passage(fitted):
    model = fitted[2]
    good = "The and of to is with that for this on are as it was be by. " * 12
    bad = " ".join(f"ndo{i}$$$ thr{i}### &&&" for i in range(quality.PASSAGE_WORDS))
    rows = quality.bag(f"{good}\n{bad}")
    attention, score = model.attention(rows, np.array([0]))
    assert attention.sum() == pytest.approx(1) and len(attention) == len(rows) > 3
    assert score[0] < model.scores([quality.bag(good)])[0]


def test_every_row_has_a_score(docs, fitted):
    model = fitted[2]
    got = quality.classify(docs, model).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in fixtures.rows())
    assert all(0 <= r.score <= 1 for r in got)
    by_text = {r[0]: r[1] for r in fixtures.rows()}
    same = {by_text[r.doc_id] or "": r.score for r in got if r.doc_id not in (9, None)}
    one_by_one = {t: model.scores([quality.bag(t)])[0] for t in same}
    assert same == pytest.approx(one_by_one)
    assert quality.score(docs, model, name="key").columns == docs.columns


def test_slices_cover_the_whole_text(monkeypatch):
    text = " ".join(f"word{i}" for i in range(1000))
    monkeypatch.setattr(quality, "SLICE", 500)
    rows = quality.bag(text)
    assert np.expm1(rows[:, quality._N_CLASSES]).sum() == pytest.approx(1000, rel=1e-4)
    assert len(quality.bag("x" * 5000)) == 10 and len(quality.bag("")) == len(quality.bag(None)) == 1


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(size=(n, quality.FEATURES)) for n in (1, 3, 5)]
    x, starts, y = np.concatenate(bags), np.array([0, 1, 4]), np.array([1.0, 0.0, 1.0])
    model = quality.fit([b.astype(np.float32) for b in bags], y.astype(int), epochs=1)
    w = model.weights

    def loss(w):
        p = quality._forward(w, x, starts)[-1]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    g = quality._gradient(w, x, starts, y)
    for k in w:
        at = tuple(0 for _ in w[k].shape)
        moved = {**w, k: w[k].copy()}
        moved[k][at] += 1e-6
        assert (loss(moved) - loss(w)) / 1e-6 == pytest.approx(g[k][at], rel=1e-3, abs=1e-7)


def test_nothing_to_learn_from(docs, no_docs, fitted):
    labels = fitted[1]
    model = quality.train(no_docs, labels)
    assert {r.score for r in quality.classify(docs, model).collect()} == {0.5}
    assert quality.classify(no_docs, model).collect() == []
