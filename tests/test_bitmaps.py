"""Bitmap pair counts and prefix-filtered rules against the baskets."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from minekit.operators import basket, bitmaps, containment


def liked(spark, rows):
    return spark.createDataFrame(rows, "user long, item long").repartition(4)


def brute(rows, min_pairs=1):
    users = defaultdict(set)
    for u, i in rows:
        users[u].add(i)
    n = Counter(p for items in users.values() for p in itertools.combinations(sorted(items), 2))
    return {p: c for p, c in n.items() if c >= min_pairs}


def as_dict(pairs):
    return {(r.item_a, r.item_b): r.n for r in pairs.collect()}


def skewed(seed, users=4000, items=60):
    """Some items that most users like, many rare ones, one user with a third of the rows, and repeats."""
    rng = random.Random(seed)
    rows = [(u, i) for u in range(users) for i in range(6) if rng.random() < 0.5 / (i + 1)]
    rows += [(rng.randrange(users), rng.randrange(6, items)) for _ in range(2000)]
    rows += [(7, i) for i in range(items, items + len(rows) // 40)]
    return rows + rng.sample(rows, 50)


@pytest.mark.parametrize("share, min_pairs", [(1, 1), (4, 3), (32, 1), (10**6, 3)])
def test_bitmap_pairs_equal_brute_force(spark, share, min_pairs):
    rows = skewed(1)
    got = bitmaps.pair_frequencies(liked(spark, rows), min_pairs, share=share).collect()
    freq = Counter(i for _, i in set(rows))
    assert {(r.item_a, r.item_b): r.n for r in got} == brute(rows, min_pairs)
    assert all((r.freq_a, r.freq_b) == (freq[r.item_a], freq[r.item_b]) for r in got)


def test_a_bucket_of_more_users_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "_FILL", 5000)  # one bucket, several chunks
    rows = [(u, i) for u in range(2500) for i in range(4) if (u * 7 + i * 3) % (i + 2) == 0]
    assert as_dict(bitmaps.pair_counts(liked(spark, rows), share=100)) == brute(rows)
    bits = bitmaps.item_bits(liked(spark, rows), 2500)
    users = len({u for u, _ in rows})
    assert {r.chunk for r in bits.select("chunk").distinct().collect()} == set(range(-(-users // 1024))) != {0}


def test_bits_count_users_once(spark):
    rows = [(u, 1) for u in range(100)] * 3
    (r,) = bitmaps.item_bits(liked(spark, rows), 100).collect()
    assert sum(bin(r[f"w{k}"] & (2**64 - 1)).count("1") for k in range(bitmaps.WORDS)) == 100


def test_dense_items_open_no_basket(spark):
    rows = [(u, i) for u in range(200) for i in range(3)]
    pairs = bitmaps.pair_counts(liked(spark, rows))
    shuffles = re.findall(r"Exchange \w+\(([^)]*)\)", pairs._jdf.queryExecution().executedPlan().toString())
    assert not any("lo#" in s for s in shuffles) and any("bucket#" in s and "chunk#" in s for s in shuffles)


def test_no_rows(spark):
    assert bitmaps.pair_counts(liked(spark, [])).collect() == []
    assert bitmaps.rules_confidence(liked(spark, [(1, 1)])).collect() == []
    assert containment.rules_confidence(liked(spark, [])).collect() == []


@pytest.mark.parametrize("min_conf, min_pairs, directed", [(0.8, 2, True), (0.5, 1, False), (0.0, 1, True), (0.75, 3, True)])
def test_rules_equal_those_of_the_baskets(spark, min_conf, min_pairs, directed):
    rng = random.Random(3)
    rows = [(u, i) for u in range(60) for i in range(12) if rng.random() < (0.95 if i % 3 else 0.3)]
    rows += [(0, i) for i in range(12, 60)] + [(u, 70) for u in range(4)] + [(u, 71) for u in range(5)]
    want = [tuple(r) for r in basket.rules_confidence(liked(spark, rows), min_conf, min_pairs, directed).collect()]
    for found in (bitmaps.rules_confidence, containment.rules_confidence):
        assert [tuple(r) for r in found(liked(spark, rows), min_conf, min_pairs, directed).collect()] == want != []


@pytest.mark.parametrize("opened", [0, 11, 64])
def test_small_and_large_baskets_count_alike(spark, opened):
    rng = random.Random(7)
    rows = [(u, i) for u in range(50) for i in range(14) if rng.random() < 0.9]
    rows += [(u, i) for u in range(50, 60) for i in range(3)] + [(u, i) for u in (1, 2) for i in range(20, 40)]
    rows += rows[:30] + [(3, None), (None, None)]
    df = spark.createDataFrame(rows, "user long, item long")
    want = [tuple(r) for r in basket.rules_confidence(df.dropna(), 0.7, 2).collect()]
    assert [tuple(r) for r in containment.rules_confidence(df, 0.7, 2, opened=opened).collect()] == want != []


def test_prefixes_open_few_candidates(spark):
    # one user likes everything: its basket alone makes all pairs, and hardly any prefix opens it
    rng = random.Random(4)
    rows = [(0, i) for i in range(300)] + [(rng.randrange(1, 500), i) for i in range(300) for _ in range(9)]
    df = liked(spark, rows)
    few = {(r.item_a, r.item_b) for r in containment.candidates(df).collect()}
    rules = {(r.item_a, r.item_b) for r in containment.rules_confidence(df).collect()}
    assert rules <= few and len(few) < 2 * len(brute(rows)) / 10
