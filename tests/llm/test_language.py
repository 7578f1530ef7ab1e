from collections import Counter
from math import log2
from pathlib import Path

import fixtures
import numpy as np
import pytest

from minekit.llm import language

DATA = "/root/testdata/sf0.01"


def brute_bits(train, text):
    """Code length under partial matching, byte by byte, from plain dictionaries."""
    counts = [{} for _ in range(4)]
    for t in train:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for k in range(4):
                counts[k].setdefault(data[i - k : i], Counter())[data[i]] += 1
    data, total = b"\0\0\0" + text.encode(), 0.0
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0, -1):
            if k < 0:
                total += 8
                break
            seen = counts[k].get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total += log2((n + d) / seen[data[i]])
                break
            total += log2((n + d) / d)
    return total


def grams(texts):
    codes, counts = np.unique(np.concatenate([language.gram_codes(t.encode()) for t in texts]), return_counts=True)
    return codes, counts.astype(float)


def test_code_lengths_equal_brute_force(monkeypatch):
    train = {"aa": ["the cat sat on the mat", "that hat"], "bb": ["été à la plage", "les chats de la plage"], "cc": ["xyzzy"]}
    trees = language.build({k: grams(v) for k, v in train.items()})
    assert trees.languages == ["aa", "bb", "cc"]
    texts = ["the plage", "chat", "q", "été hat xyz", "中文 and more", "a" * 50, "zz\nzz"]
    for text in [*texts, *sum(train.values(), [])]:
        want = [brute_bits(train[k], text) for k in trees.languages]
        assert trees.code_lengths(text).tolist() == pytest.approx(want, rel=1e-5), text
    monkeypatch.setattr(language, "_SLICE", 5)
    for text in texts:
        assert trees.code_lengths(text).tolist() == pytest.approx([brute_bits(train[k], text) for k in trees.languages], rel=1e-5)


@pytest.fixture(scope="module")
def trees(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    return language.train(spark.read.parquet(f"{DATA}/documents.parquet"))


def test_held_out_accuracy(spark, trees):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language.identify(docs, trees).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 250
    assert sum(r.lang_pred == r.lang for r in got) / len(got) >= 0.98


def test_every_row(docs, no_docs, trees):
    got = language.identify(docs, trees).collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r[0]) for r in fixtures.rows())
    texts = {r[0]: r[1] for r in fixtures.rows()}
    for r in got:
        letters = any(map(str.isalpha, texts[r.doc_id] or ""))
        if r.doc_id not in (9,):
            assert (r.lang_pred == "und") == (not letters) and (r.score == 0) == (not letters)
        assert 0 <= r.score <= 1
    assert language.identify(no_docs, trees).collect() == []


def test_nothing_to_learn_from(docs, no_docs):
    assert language.train(no_docs) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    # a language is learned from rows with text, language and id alone
    small = language.train(docs, max_train=1)
    assert set(small.languages) <= {"en", "fr", "de"}


def test_held_out_texts_are_predicted_once(spark, monkeypatch, capsys):
    rows = [(i, w, lang) for i in range(60) for lang, w in (("en", f"the cat sat {i}"), ("de", f"über das Maß {i}"))]
    rows += [(i, None, "en") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.train(docs)
    asked, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: asked.append(df) or collect(df))
    usual = language.usual_bits(docs, trees)
    assert usual and language.UNKNOWN not in usual
    capsys.readouterr()
    asked[-1].explain()
    # a second one would hold a second Python worker in each task, which stays
    assert capsys.readouterr().out.split("Initial Plan")[0].count("ArrowEvalPython") == 1


def test_usual_bits_asks_every_held_out_text(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "".join(rng.choice(list("abc xyzäß"), 20 + i % 30)), "en" if i % 3 else "de") for i in range(3000)]
    rows += [(None, "abc", "en"), (3000, "zz", None), (3001, None, "de")] + rows[:7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.train(docs)
    asked = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    bits = {}
    for r in language.identify(asked, trees).where("held_out").collect():
        bits.setdefault(r.lang_pred, []).append(r.bits)
    assert sum(map(len, bits.values())) > 2 * language.MAX_TRAIN
    want = {k: float(np.median(v)) for k, v in bits.items() if k != language.UNKNOWN}
    assert language.usual_bits(docs, trees) == pytest.approx(want, rel=1e-12)
