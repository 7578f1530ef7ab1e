import hashlib

import fixtures
import pytest
from pyspark.sql import functions as F

from minekit.llm import winnow


def test_edited_text_and_order(docs):
    data = fixtures.rows()
    got = winnow.digest_columns(winnow.edited_pairs(docs)).collect()
    assert len(got) == len(data)
    texts = {(r[0], r[1] or "") for r in data}
    edits = {}
    for r in got:
        edits.setdefault(r.doc_id, set()).add((r.n_chars, r.edited_sha256))
    ids = [i for i, _ in texts]
    unique = {i: t for i, t in texts if ids.count(i) == 1}
    order = sorted((i for i in set(ids) if i is not None), reverse=True)
    for i, j in zip(order, order[1:]):
        if i in unique and j in unique:
            text, cut = unique[i], len(unique[i]) // 3
            edited = text[: len(text) - cut] + unique[j][:cut]
            assert edits[i] == {(len(text), hashlib.sha256(edited.encode()).hexdigest())}
    # the row without id is last and is followed by the first
    cut = len(unique[None]) // 3
    edited = unique[None][: len(unique[None]) - cut] + unique[order[0]][:cut]
    assert edits[None] == {(len(unique[None]), hashlib.sha256(edited.encode()).hexdigest())}


def test_equal_texts_have_equal_fingerprints(docs):
    got = winnow.digest_columns(winnow.edited_pairs(docs)).collect()
    texts = {}
    for r in fixtures.rows():
        texts.setdefault(r[0], set()).add(r[1] or "")
    prints = {r.doc_id: r.fingerprint for r in got if len(texts[r.doc_id]) == 1}
    assert prints[12] == prints[15]
    assert len({prints[i] for i in (0, 33, 12, 18, 24, 1000)}) == 6
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    long = next(r for r in got if r.doc_id == 1000)
    assert long.near_edited > 0.4 > long.near_next


def test_window_minima_equal_brute_force(spark):
    words = "b a n a n a s a n d b a n a n a b r e a d a n d j a m a n d b a n a n a s".split()
    for n in (0, 1, 2, 3, 4, 5, 6, 7, 12, len(words)):
        text = " ".join(words[:n])
        (row,) = winnow.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
        # the hashes themselves from windows of one
        h = [r[0] for r in spark.createDataFrame([(w,) for w in words[:n]], "w string")
             .select(F.pmod(F.xxhash64("w"), F.lit(2**31 - 1))).collect()]
        h += [0] * (3 - n if 0 < n < 3 else 0)
        b = 1_000_003
        grams = [(h[i] * b * b + h[i + 1] * b + h[i + 2]) % (2**31 - 1) for i in range(len(h) - 2)]
        want = set()
        for i in range(max(len(grams) - 3, 1) if grams else 0):
            window = list(enumerate(grams))[i : i + 4]
            least = min(g for _, g in window)
            want.add((least, max(p for p, g in window if g == least)))
        assert sorted((x.hash, x.position) for x in row.fingerprint) == sorted(want)


def test_shared_passage_is_found(spark):
    common = " ".join(f"c{i}" for i in range(winnow.K + winnow.WINDOW - 1))
    data = [(i, f"{' '.join(f'x{i}{j}' for j in range(9))} {common} {' '.join(f'y{i}{j}' for j in range(5 + i))}") for i in range(6)]
    rows = winnow.fingerprints(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert set.intersection(*[{x.hash for x in r.fingerprint} for r in rows])


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    data = fixtures.rows()[4 : 4 + n]
    got = winnow.digest_columns(winnow.edited_pairs(fixtures.table(spark, data))).collect()
    assert len(got) == n and all(r.near_next == 1.0 for r in got)
