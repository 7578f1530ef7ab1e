"""Stores that grow by batches, and dictionaries of ids."""

import itertools
import random
from collections import Counter, defaultdict

import pytest

from minekit.operators import basket, dictionary, stripe_store
from minekit.operators.scale import scratch_path


def liked(spark, rows):
    return spark.createDataFrame(rows, "user long, item long").repartition(3)


def brute(rows):
    users = defaultdict(set)
    for u, i in rows:
        users[u].add(i)
    return Counter(p for items in users.values() for p in itertools.combinations(sorted(items), 2))


def pairs(spark, path):
    return {(r.item_a, r.item_b): r.n for r in stripe_store.pair_counts(spark, path).collect()}


def test_batches_equal_one_table(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(30), rng.randrange(25)) for _ in range(400)] + [(99, i) for i in range(40)]
    path = scratch_path(spark, "store")
    stripe_store.create(spark, path)
    assert pairs(spark, path) == {}
    seen = []
    for number, part in enumerate((rows[:150], rows[100:], [], rows[:50]), 1):
        stripe_store.add(spark, path, number, liked(spark, [*part, (None, 1), (2, None)]), block=10)
        seen += part
        assert pairs(spark, path) == brute(seen)
    want = {(r.item_a, r.part): r.stripe for r in basket.item_stripes(basket.pair_counts(liked(spark, rows))).collect()}
    assert {(r.item_a, r.part): r.stripe for r in stripe_store.item_stripes(spark, path).collect()} == want
    assert stripe_store.liked(spark, path).count() == len(set(rows))


def test_old_rows_are_not_counted_again(spark):
    path = scratch_path(spark, "store")
    stripe_store.create(spark, path)
    stripe_store.add(spark, path, 1, liked(spark, [(1, i) for i in range(20)] + [(2, 1), (2, 2)]))
    stripe_store.add(spark, path, 2, liked(spark, [(1, 20)]))
    added = spark.read.parquet(f"{path}/pairs/batch=2")
    assert added.count() == 20  # the new row with each old one of its user


def test_a_batch_that_failed_is_not_seen_and_can_be_repeated(spark, monkeypatch):
    path = scratch_path(spark, "store")
    stripe_store.create(spark, path)
    stripe_store.add(spark, path, 1, liked(spark, [(1, 1), (1, 2)]))
    # pairs written, rows not: as after a crash in between
    spark.createDataFrame([(1, 3, 5), (2, 3, 1)], "item_a long, item_b long, n long").write.parquet(f"{path}/pairs/batch=2")
    assert pairs(spark, path) == {(1, 2): 1}
    stripe_store.add(spark, path, 2, liked(spark, [(1, 3)]))
    assert pairs(spark, path) == {(1, 2): 1, (1, 3): 1, (2, 3): 1}
    for number in (0, 2):
        with pytest.raises(ValueError):
            stripe_store.add(spark, path, number, liked(spark, []))


def test_pairs_are_not_dealt_by_batch(spark):
    path = scratch_path(spark, "store")
    stripe_store.create(spark, path)
    stripe_store.add(spark, path, 1, liked(spark, [(1, 1), (1, 2)]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many pairs
    try:
        counted = stripe_store.pair_counts(spark, path)
        plan = counted._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the batches are told apart once; the pairs, of which a batch has many, stay where they are read
    assert "SortMergeJoin" not in plan and plan.count("hashpartitioning(batch") == 1
    assert [tuple(r) for r in counted.collect()] == [(1, 2, 1)]


def test_ids_stay_and_go_on(spark):
    path = scratch_path(spark, "ids")
    dictionary.create(spark, path, "string")
    first = spark.createDataFrame([("b",), ("d",), (None,), ("b",)], "name string")
    dictionary.extend(spark, path, first, "name", 1)
    second = spark.createDataFrame([("a",), ("d",), ("c",)], "name string")
    dictionary.extend(spark, path, second, "name", 2)
    dictionary.extend(spark, path, first, "name", 3)
    known = {r.key: r.idx for r in dictionary.entries(spark, path).collect()}
    assert known == {"b": 0, "d": 1, "a": 2, "c": 3}
    rows = spark.createDataFrame([("d", 1), (None, 2), ("x", 3)], "name string, `a.b` long")
    got = dictionary.encoded(rows, path, "name")
    assert got.columns == ["name", "a.b"]
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 1), (None, 2), (None, 3)]
    with pytest.raises(ValueError):
        dictionary.extend(spark, path, first, "name", 0)
