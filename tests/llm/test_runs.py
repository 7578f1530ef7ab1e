"""Runs of words against all starts and periods tried one by one."""

import hashlib
import random
import zlib
from pathlib import Path

import fixtures
import pytest

from minekit.llm import queries
from minekit.llm.runs import SquareCatcher, collapsed, find_runs, planted

DATA = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i - start + q), q)  # the smallest period of the stretch
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def samples():
    rng = random.Random(3)
    for _ in range(1500):
        letters = rng.choice([1, 2, 2, 3, 4, 30])
        words = [rng.randrange(letters) for _ in range(rng.randrange(130))]
        for _ in range(rng.randrange(4)):
            part = [rng.randrange(letters + 1) for _ in range(rng.randrange(1, 25))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (part * 9)[: rng.randrange(1, 9 * len(part))]
        yield words


def test_runs_equal_brute_force():
    for words in samples():
        for least in (2, 12):
            assert SquareCatcher(least).extend(words).finish() == brute(words, least)


def test_words_one_by_one():
    for words in list(samples())[:100]:
        catcher = SquareCatcher()
        for w in words:
            catcher.extend([w])
        assert catcher.finish() == brute(words)


@pytest.mark.parametrize("kind", ["same", "powers", "fibonacci", "blocks"])
def test_repetitive_texts_stay_cheap(kind):
    fib = [0], [0, 1]
    while len(fib[1]) < 20_000:
        fib = fib[1], fib[1] + fib[0]
    words = {
        "same": [0] * 20_000,
        "powers": ([0] * 1000 + [1]) * 20,
        "fibonacci": fib[1],
        "blocks": sum(([0] * (900 + 10 * i) + [1] for i in range(20)), []),
    }[kind]
    runs = SquareCatcher().extend(words).finish()
    for start, length, period in runs:
        end = start + length
        assert words[start : end - period] == words[start + period : end]
        assert start == 0 or words[start - 1] != words[start - 1 + period]
        assert end == len(words) or words[end] != words[end - period]
    if kind == "same":
        assert runs == [(0, 20_000, 1)]
    if kind == "powers":
        assert (0, len(words), 1001) in runs and len(runs) == 21


def want(doc_id, text):
    words = planted((text or "").encode().split(), doc_id)
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    text = b" ".join(w for i, w in enumerate(words) if i not in drop)
    assert text == b" ".join(collapsed(words, runs))
    return (
        doc_id, len(runs), best[0], best[1], best[2], best[2] and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest(),
    )


def test_query_equals_brute_force(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    # brute force is quadratic: the shorter texts, and the planted runs of them
    short = [r for r in rows if len((r.text or "").split()) <= 1200]
    assert len(short) > 150 and any(zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in short)
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = queries.op11_runs(spark, DATA)
    assert got.count() == len(rows)
    got = {r.doc_id: tuple(r) for r in got.select(names).collect()}
    assert [got[r.doc_id] for r in short] == [want(r.doc_id, r.text) for r in short]


def test_odd_rows(docs, no_docs):
    got = find_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"]
    rows = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got.collect()]
    expected = []
    for key, text, *_ in fixtures.rows():
        words = (text or "").encode().split()
        runs = brute(words) if len(words) < 2000 else SquareCatcher().extend([hash(w) % 2**40 for w in words]).finish()
        expected.append((key, len(words), runs, b" ".join(collapsed(words, runs)).decode()))
    assert sorted(rows, key=repr) == sorted(expected, key=repr)
    assert find_runs(no_docs).collect() == []
