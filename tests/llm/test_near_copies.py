import random
from pathlib import Path

import fixtures
import numpy as np
import pytest

import corpus_pipeline
from minekit.llm import near_copies
from minekit.llm.common import documents

DATA = "/root/testdata/sf0.001"


def words(text):
    return text.encode().lower().split()


def brute_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}


def brute_survivors(rows):
    sets = [brute_set(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    ids = {}
    for (key, _), k in zip(rows, label):
        ids[k] = min(ids.get(k, key), key)
    return sorted(ids.values())


def edited(rng, text, changes):
    w = text.split()
    for i in rng.sample(range(len(w)), changes):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("tile", [4096, 8])
def test_edited_copies_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(near_copies, "TILE", tile)
    rng = random.Random(11)
    rows = []
    for _ in range(12):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
        rows.append(base)
        rows += [edited(rng, base, k) for k in (0, 1, 2, 3, 4, 5, 8, 12)]
        rows.append(edited(rng, rows[-3], 2))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(r.doc_id for r in near_copies.one_of_each(df).collect())
    assert got == brute_survivors(rows) and len(got) < 60


def template(n, changes, words=200):
    rng = random.Random(2)
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(words))
    return [(i, edited(rng, base, changes)) for i in range(n)]


def test_many_near_copies_of_one_text(spark):
    df = spark.createDataFrame(template(20_000, 2), "doc_id long, text string").repartition(8)
    assert [r.doc_id for r in near_copies.one_of_each(df).collect()] == [0]


def test_many_texts_of_one_template_below_the_bound(spark):
    df = spark.createDataFrame(template(20_000, 12), "doc_id long, text string").repartition(8)
    assert near_copies.one_of_each(df).count() == 20_000


def test_fingerprints_alone_make_candidates(spark):
    """Without a shared band, links within the radius decide who is compared."""
    sets = {1: range(20), 2: range(1, 21), 3: range(12, 40), 4: range(1, 20)}
    bits = {1: 0, 2: 0b111111, 3: 0b1, 4: -1}  # the fourth is near by its set, but not by its fingerprint
    distinct = spark.createDataFrame([(d, bits[d], [100 * d]) for d in sets], "digest long, bits long, bands array<long>")
    packed = [(d, bytearray(np.array(list(x), np.uint64).tobytes())) for d, x in sets.items()]
    hashes = spark.createDataFrame(packed, "digest long, hashes binary")
    found = near_copies.parts_of(distinct, lambda d: hashes.join(d, "digest"), 0.8)
    assert sorted(map(tuple, found.collect())) == [(2, 1)]


def test_linked_equals_brute_force(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 14, 12)).astype(np.uint64) for _ in range(60)]
    label = np.arange(60)
    while True:
        near = [[len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for y in sets] for x in sets]
        new = np.array([label[row].min() for row in np.array(near)])
        if (new == label).all():
            break
        label = new
    for frequent in (2, 5, 1000):
        monkeypatch.setattr(near_copies, "FREQUENT", frequent)
        assert near_copies.linked(sets).tolist() == label.tolist()


def test_a_start_that_is_known_is_kept():
    sets = [np.arange(i, i + 20).astype(np.uint64) for i in (0, 100, 1, 101, 300)]
    found = near_copies.Apart(sets, 0.8, np.array([0, 0, 2, 3, 4]))
    found.join(range(2))
    assert found.root.tolist() == [0, 0, 0, 0, 4]


def test_stage_equals_brute_force(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    docs = documents(spark, DATA)
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.near_dedup(spark, docs, DATA)
    assert got.dtypes == docs.dtypes
    assert sorted(r.doc_id for r in got.collect()) == brute_survivors(rows)


def test_rows_without_id_or_text(docs, no_docs):
    kept = near_copies.one_of_each(docs)
    assert kept.columns == docs.columns
    data = [(r[0] if r[0] is not None else 10**6, r[1] or "") for r in fixtures.rows()]
    got = sorted(10**6 if r.doc_id is None else r.doc_id for r in kept.collect())
    assert got == brute_survivors(data)
    assert near_copies.one_of_each(no_docs).collect() == []


def test_columns_with_clashing_names(spark):
    names = ["_row_key", "digest", "a.b", "key", "n"]
    rows = [(i, f"text number {i // 2} " * 9, *[f"{c}{i}" for c in names]) for i in range(10)]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    kept = near_copies.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [r for r in rows if r[0] % 2 == 0]


def test_one_of_rows_with_the_same_id_and_text(spark):
    rows = [(1, "some text", "b"), (1, "some text", "a"), (1, "some text", "a"), (2, None, None), (3, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    first = sorted(map(tuple, near_copies.one_of_each(df).collect()), key=repr)
    assert [r[0] for r in first] == [1, 2]
    assert first == sorted(map(tuple, near_copies.one_of_each(df.repartition(5)).collect()), key=repr)


def test_a_very_long_text(spark):
    rng = random.Random(8)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(600_000))  # 4.6 MB
    rows = [(1, long), (2, edited(rng, long, 10_000)), (3, edited(rng, long, 60_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.one_of_each(df).collect()) == [1, 3]
