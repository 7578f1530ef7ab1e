import itertools
import random
from collections import Counter, defaultdict

import pytest

from minekit.operators import basket


def liked(spark, rows):
    return spark.createDataFrame(rows, "user long, item long").distinct()


def brute_pairs(rows, min_pairs=1):
    users = defaultdict(set)
    for u, i in rows:
        users[u].add(i)
    n = Counter(p for items in users.values() for p in itertools.combinations(sorted(items), 2))
    return {p: c for p, c in n.items() if c >= min_pairs}


def as_dict(pairs):
    return {(r.item_a, r.item_b): r.n for r in pairs.collect()}


def skewed_rows(seed=3):
    """A third of the rows belong to one user, another user is large too."""
    rnd = random.Random(seed)
    rows = [(0, i) for i in range(60)] + [(1, i) for i in range(20, 55)]
    rows += [(rnd.randrange(2, 30), rnd.randrange(0, 70)) for _ in range(120)]
    return rows


def test_liked_filters_parses_and_deduplicates(spark):
    raw = spark.createDataFrame(
        [(1, 10, "4.0"), (1, 10, "5"), (1, 11, "3.9"), (2, 10, "x"), (2, None, "5"), (3, 12, None)],
        "user long, item long, rating string",
    )
    assert {tuple(r) for r in basket.liked_items(raw).collect()} == {(1, 10)}


def test_stripe_expansion_of_one_basket(spark):
    rows = [(1, 1), (1, 2), (1, 3), (1, 4)]
    stripes = basket.item_stripes(basket.pair_counts(liked(spark, rows)))
    got = {r.item_a: r.stripe for r in stripes.collect()}
    assert got == {1: {2: 1, 3: 1, 4: 1}, 2: {3: 1, 4: 1}, 3: {4: 1}}


def test_stripe_merge_keeps_keys_of_both_sides(spark):
    rows = [(1, 1), (1, 2), (2, 1), (2, 3), (3, 1), (3, 2)]
    stripes = basket.item_stripes(basket.pair_counts(liked(spark, rows)))
    assert {r.item_a: r.stripe for r in stripes.collect()} == {1: {2: 2, 3: 1}}
    looked_up = stripes.select(basket.stripe_value("stripe", 2), basket.stripe_value("stripe", 9)).first()
    assert tuple(looked_up) == (2, 0)


def test_single_item_and_empty_baskets_have_no_pairs(spark):
    assert as_dict(basket.pair_counts(liked(spark, [(1, 7)]))) == {}
    assert as_dict(basket.pair_counts(liked(spark, []), min_pairs=2)) == {}


@pytest.mark.parametrize("min_pairs", [1, 2, 3, 4])
@pytest.mark.parametrize("block", [3, 8, 34, 1000])
def test_pair_counts_match_brute_force_however_baskets_are_cut(spark, min_pairs, block):
    rows = skewed_rows()
    got = as_dict(basket.pair_counts(liked(spark, rows), min_pairs, block))
    assert got == brute_pairs(rows, min_pairs)


@pytest.mark.parametrize("partitions", [1, 8])
def test_pairs_do_not_depend_on_partitioning(spark, partitions):
    rows = skewed_rows(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, "user long, item long").repartition(partitions).distinct()
        assert as_dict(basket.pair_counts(df, 2, 10)) == brute_pairs(rows, 2)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_string_items(spark):
    rows = [(1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c")]
    df = spark.createDataFrame(rows, "user long, item string")
    assert as_dict(basket.pair_counts(df)) == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}


def test_long_lists_are_split_and_complete(spark):
    rows = skewed_rows()
    parts = basket.user_baskets(liked(spark, rows), max_items=10).collect()
    whole = defaultdict(list)
    for r in parts:
        assert r.items == sorted(r.items)
        whole[r.user].extend(r.items)
    expected = defaultdict(set)
    for u, i in rows:
        expected[u].add(i)
    assert {u: sorted(v) for u, v in whole.items()} == {u: sorted(v) for u, v in expected.items()}
    assert len([r for r in parts if r.user == 0]) > 1

    stripes = basket.item_stripes(basket.pair_counts(liked(spark, rows)), max_entries=7).collect()
    rebuilt = {(r.item_a, b): n for r in stripes for b, n in r.stripe.items()}
    assert rebuilt == brute_pairs(rows)


def test_confidence_bound_is_strict_and_single_pairs_are_excluded(spark):
    rows = [(u, 1) for u in range(5)] + [(u, 2) for u in range(4)]  # P(2|1) = 4/5, P(1|2) = 1
    rows += [(9, 3), (9, 4)]  # a single pair with confidence 1
    rules = {(r.item_a, r.item_b): r.confidence for r in basket.rules_confidence(liked(spark, rows)).collect()}
    assert rules == {(2, 1): 1.0}
    one_way = basket.rules_confidence(liked(spark, rows), directed=False)
    assert one_way.count() == 0


@pytest.mark.parametrize("denominator", ["rows", "baskets"])
def test_lift_matches_brute_force_and_is_sorted(spark, denominator):
    rows = sorted(set(skewed_rows()))
    freq = Counter(i for _, i in rows)
    total = len(rows) if denominator == "rows" else len({u for u, _ in rows})
    expected = {
        p: n * total / (freq[p[0]] * freq[p[1]])
        for p, n in brute_pairs(rows).items()
        if n * total > 2.5 * freq[p[0]] * freq[p[1]]
    }
    got = basket.rules_lift(liked(spark, rows), denominator=denominator, block=9).collect()
    assert {(r.item_a, r.item_b): pytest.approx(r.lift) for r in got} == expected
    assert [r.lift for r in got] == sorted((r.lift for r in got), reverse=True)


def test_by_count_is_sorted(spark):
    got = [tuple(r) for r in basket.by_count(basket.pair_counts(liked(spark, skewed_rows()))).collect()]
    assert got == sorted(got, key=lambda r: (-r[2], r[0], r[1]))


def test_titles_default_missing_and_repeated_ids(spark):
    pairs = spark.createDataFrame([(1, 2, 3), (1, 9, 1)], "item_a long, item_b long, n long")
    titles = spark.createDataFrame([(1, "one"), (2, "two"), (2, "zwei")], "item long, title string")
    named = basket.with_titles(pairs, ["item_a", "item_b"], titles)
    assert sorted((r.title_a, r.title_b) for r in named.collect()) == [("one", ""), ("one", "two")]
    optional = basket.with_titles(pairs, ["item_b"], titles, default=None)
    assert {r.item_b: r.title_b for r in optional.collect()} == {2: "two", 9: None}


def test_equal_titles_are_not_merged(spark):
    rows = [(1, 1), (1, 2), (1, 3)]
    titles = spark.createDataFrame([(1, "a"), (2, "same"), (3, "same")], "item long, title string")
    stripes = basket.stripes_named(basket.pair_counts(liked(spark, rows)), titles).collect()
    first = next(r for r in stripes if r.item_a == 1)
    assert first.title_a == "a"
    assert [(e.item, e.title, e.n) for e in first.stripe] == [(2, "same", 1), (3, "same", 1)]


def test_one_user_with_a_third_of_all_rows(spark):
    """Expanding that basket would make 200 million pairs; it is looked up instead."""
    rnd = random.Random(8)
    hot = 20_000
    others = {(u, rnd.randrange(0, 2 * hot)) for u in range(1, 4001) for _ in range(10)}
    rows = [(0, i) for i in range(hot)] + sorted(others)
    got = as_dict(basket.pair_counts(liked(spark, rows), min_pairs=2))
    baskets = defaultdict(list)
    for u, i in sorted(others):
        baskets[u].append(i)
    n = Counter(p for items in baskets.values() for p in itertools.combinations(items, 2))
    expected = {p: c + (p[1] < hot) for p, c in n.items() if c + (p[1] < hot) >= 2}
    assert got == expected


@pytest.mark.parametrize("min_pairs", [1, 2, 3])
def test_repeated_rows_count_once(spark, min_pairs):
    rows = [(u, i) for u in range(6) for i in range(12) if (u * i + u) % 3] + [(1, 1), (1, 2), (1, 1), (2, 1), (2, 2)]
    liked = spark.createDataFrame(rows * 2, "user int, item int")
    baskets = {}
    for u, i in rows:
        baskets.setdefault(u, set()).add(i)
    want = {}
    for items in baskets.values():
        for a in items:
            for b in items:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    got = {(r.item_a, r.item_b): r.n for r in basket.pair_counts(liked, min_pairs, block=4).collect()}
    assert got == {p: n for p, n in want.items() if n >= min_pairs}
    freq = {r["item"]: r.freq for r in basket.item_frequency(liked).collect()}
    assert freq == {i: sum(i in items for items in baskets.values()) for i in set().union(*baskets.values())}


def test_lookup_over_the_parts_of_a_stripe(spark):
    pairs = spark.createDataFrame([(0, i, i * 10) for i in range(1, 13)] + [(5, 7, 1)], "item_a int, item_b int, n long")
    stripes = basket.item_stripes(pairs, max_entries=4)
    assert stripes.where("item_a = 0").count() > 1
    assert {r.item_a: r.n for r in basket.stripe_lookup(stripes, 7).collect()} == {0: 70, 5: 1}
    assert {r.item_a: r.n for r in basket.stripe_lookup(stripes, 99).collect()} == {0: 0, 5: 0}
