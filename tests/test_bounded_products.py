"""Largest products by length bounds, distinct texts by digests, trees as tables."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from minekit.operators import digests, models, products, text, trees
from minekit.operators.scale import dealt


def brute(users, items, n):
    out = []
    for u, v in users:
        if u is None or v is None:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in items if i is not None and w is not None)
        out += [(u, r, i, -s) for r, (s, i) in enumerate(scores[:n], 1)]
    return sorted(out)


def tables(spark, users, items):
    return (
        spark.createDataFrame(users, "user bigint, vector array<double>"),
        spark.createDataFrame(items, "item bigint, vector array<double>"),
    )


def collected(top):
    return sorted((r.user, r.rank, r.item, r.score) for r in top.collect())


@pytest.mark.parametrize(("n_items", "n", "chunk", "widest"), [(300, 5, 8, 4), (3, 5, 8, 512), (64, 1, 1, 2), (40, 7, 40, 1)])
def test_top_products_equal_all_products(spark, n_items, n, chunk, widest):
    rng = random.Random(n_items)
    vector = lambda size: [float(rng.randint(-9, 9) * size) for _ in range(3)]
    users = [(u, vector(1)) for u in range(30)] + [(50, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (51, None)]
    items = [(i, vector(1 + i % 13)) for i in range(n_items)] + [(900, None), (None, [9.0, 9.0, 9.0])]
    top, work = products.top_products(*tables(spark, users, items), n, chunk, widest)
    assert collected(top) == brute(users, items, n)
    rounds = work.orderBy("round").collect()
    assert [r.round for r in rounds] == list(range(len(rounds)))
    assert rounds[0].n_users == 31 and rounds[0].n_chunks == 31


def test_ties_go_to_the_smaller_item_of_any_chunk(spark):
    users, items = [(1, [1.0, 0.0])], [(i, [2.0, float(i % 5)]) for i in range(40)]
    top, _ = products.top_products(*tables(spark, users, items), 5, 4, 2)
    assert [r[2] for r in collected(top)] == [0, 1, 2, 3, 4]


def test_bounds_leave_out_short_items(spark):
    users = [(u, [math.cos(u), math.sin(u)]) for u in range(20)]
    items = [(i, [math.cos(i) * 0.9**i, math.sin(i) * 0.9**i]) for i in range(400)]
    top, work = products.top_products(*tables(spark, users, items), 3, 4, 2)
    assert [r[:3] for r in collected(top)] == [r[:3] for r in brute(users, items, 3)]
    assert sum(r.n_products for r in work.collect()) < 20 * 400 / 4


def test_inexact_products_are_sums_in_order(spark):
    """Scores that a matrix product rounds otherwise, near ties among them, are those of plain sums."""
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(10)]
    base = [vector() for _ in range(40)]
    items = [(i, [x * (1 + 2**-52 * (i % 3)) for x in base[i % 40]]) for i in range(400)]
    users = [(u, vector()) for u in range(1500)]
    top, work = products.top_products(*tables(spark, users, items), 5, 32, 4)

    def product(v, w):
        out = 0.0
        for a, b in zip(v, w):  # sum() rounds less
            out += a * b
        return out

    want = [(u, sorted((-product(v, w), i) for i, w in items)[:5]) for u, v in users]
    assert collected(top) == [(u, r, i, -s) for u, found in want for r, (s, i) in enumerate(found, 1)]
    assert work.count() == 5  # 1, 2, 4, 4 and the last 2 chunks


def test_items_with_a_missing_number_come_first_where_they_are_met(spark):
    items = [(1, [0.0, 0.0]), (2, [0.0, None]), (3, [3.0, 0.0]), (4, [4.0, 0.0]), (5, [None, 1.0])]
    users = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [None, 1.0])]
    top, _ = products.top_products(*tables(spark, users, items), 2, 2)
    assert collected(top) == [(1, 1, 4, 4.0), (1, 2, 3, 3.0), (2, 1, 2, None), (2, 2, 1, 0.0)]


def test_ids_are_texts_or_numbers(spark):
    users = spark.createDataFrame([("x", [1.0]), ("y", [-1.0])], "user string, vector array<double>")
    items = spark.createDataFrame([(f"i{k}", [float(k // 2)]) for k in range(20)], "item string, vector array<double>")
    got = collected(products.top_products(users, items, 3, 2)[0])
    assert [r[:3] for r in got if r[0] == "x"] == [("x", 1, "i18"), ("x", 2, "i19"), ("x", 3, "i16")]
    assert [r[2] for r in got if r[0] == "y"] == ["i0", "i1", "i2"]


def test_many_products_take_little_time(spark):
    """A hundred million products of vectors of one length, where no bound helps, in seconds."""
    angle = lambda c: F.array(F.cos(c), F.sin(c))
    users = spark.range(10_000).select(F.col("id").alias("user"), angle(F.col("id") * 0.7).alias("vector"))
    items = spark.range(10_000).select(F.col("id").alias("item"), angle(F.col("id") * 0.3).alias("vector"))
    start = time.monotonic()
    top, work = products.top_products(users, items)
    assert top.count() == 50_000 and work.agg(F.sum("n_products")).first()[0] > 9 * 10**7
    assert time.monotonic() - start < 60


@pytest.mark.parametrize(("users", "items"), [([], [(1, [1.0])]), ([(1, [1.0])], []), ([], [])])
def test_empty_sides_give_no_products(spark, users, items):
    top, work = products.top_products(*tables(spark, users, items))
    assert top.collect() == [] and top.columns == ["user", "rank", "item", "score"]
    assert sum(r.n_products for r in work.collect()) == 0


def test_distinct_texts_equal_grouping_by_text(spark):
    rng = random.Random(3)
    data = [(i, rng.choice(["", "a", "b " * 2000, None, f"own {i}"])) for i in range(200)] + [(None, "a"), (None, "x")]
    df = spark.createDataFrame(data, "doc bigint, text string")
    want = {}
    for i, x in data:
        if x is not None:
            want[x] = min((k for k in (want.get(x), i) if k is not None), default=None)
    got = [tuple(r) for r in digests.distinct_texts(df, "text", "doc").collect()]
    assert len(got) == len(want) and {v: k for k, v in got} == want
    assert digests.distinct_texts(df.where("false"), "text", "doc").collect() == []


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(digests.F, "xxhash64", lambda c: digests.F.length(c).cast("bigint"))
    df = spark.createDataFrame([(1, "ab"), (2, "cd"), (3, "ab"), (4, "xyz")], "doc bigint, text string")
    assert sorted(map(tuple, digests.distinct_texts(df, "text", "doc").collect())) == [(1, "ab"), (2, "cd"), (4, "xyz")]


def test_only_repeated_texts_are_shuffled(spark, tmp_path):
    rows = [(i, f"text {i} " + "w " * 300) for i in range(3000)] + [(i, "copy " + "w " * 300) for i in range(3000, 3010)]
    df = spark.createDataFrame(rows, "id bigint, content string")
    df = df.selectExpr("id", "content", "'English' AS language")
    df.write.parquet(str(tmp_path / "texts"))
    df = spark.read.parquet(str(tmp_path / "texts"))
    by_digest, plain = digests.distinct_texts(df, "content", "id"), text.dedup_with_id(df, key="id")
    assert sorted(map(tuple, by_digest.collect())) == sorted(map(tuple, plain.collect()))
    plan = by_digest._jdf.queryExecution().executedPlan().toString()
    # the texts alone in their digest meet no shuffle: the one there is belongs to the copies
    assert len(re.findall(r"Exchange hashpartitioning", plan.split("== Initial Plan ==")[0])) == 1
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def stepped(spark):
    data = [(i, float(i % 50), float(i % 7), (i % 50) // 10 * 10.0 + (i % 7 > 3)) for i in range(2000)]
    return spark.createDataFrame(data, "id bigint, a double, b double, label double")


@pytest.mark.parametrize(
    ("kind", "params"),
    [("dt", {}), ("dt", {"maxDepth": 0}), ("dt_class", {}), ("rf", {"numTrees": 4}), ("gbt", {"maxIter": 4})],
)
def test_stored_trees_score_like_the_model(spark, tmp_path, kind, params):
    df = stepped(spark)
    model = models.fit_all(df, kind, ["a", "b"], "label", maxBins=64, **params)
    trees.tree_table(spark, model).write.parquet(str(tmp_path / "trees"))
    stored = trees.score(spark.read.parquet(str(tmp_path / "trees")), models.score(model, df), ["a", "b"], "stored")
    assert stored.where("abs(stored - prediction) > 1e-9 OR stored IS NULL").count() == 0
    plan = stored.select("stored")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_edges_of_a_stored_tree(spark):
    listing = "T: depth=2\n  If (feature 0 <= 1.5)\n   If (feature 1 in {0.0,2.0})\n    Predict: -1.0\n   Else (feature 1 not in {0.0,2.0})\n    Predict: 1.0E-5\n  Else (feature 0 > 1.5)\n   Predict: 3.0\n"
    rows = list(trees.parse(listing))
    assert [r[2:5] for r in rows] == [(0, None, None), (1, 0, "left"), (2, 1, "left"), (3, 1, "right"), (4, 0, "right")]
    table = spark.createDataFrame(rows, trees.SCHEMA)
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, 1.5, 2.0), (2, 1.5, 1.0), (3, 1.6, 0.0), (4, nan, 0.0), (5, None, 0.0), (6, 9.0, None)],
        "id int, `a.b` double, `c``d` double",
    )
    got = {r.id: r.prediction for r in trees.score(table, df, ["a.b", "c`d"]).collect()}
    assert got == {1: -1.0, 2: 1e-5, 3: 3.0, 4: 3.0, 5: None, 6: None}
    assert trees.score(table.where("false"), df, ["a.b", "c`d"]).where("prediction IS NOT NULL").count() == 0


@pytest.mark.parametrize("listing", ["", "T:\n If (feature 0 <= 1.0)\n  Predict: 1.0\n", "T:\n Predict: 1.0\n Predict: 2.0\n"])
def test_broken_texts_are_errors(listing):
    with pytest.raises(ValueError):
        list(trees.parse(listing))


def test_classifying_forests_are_refused(spark, monkeypatch):
    monkeypatch.setattr(trees, "tree_text", lambda model: "RandomForestClassificationModel: numTrees=2")
    with pytest.raises(ValueError):
        trees.tree_table(spark, None)


def test_models_do_not_depend_on_the_layout_of_the_input(spark):
    df = stepped(spark).selectExpr("*", "sin(id) * 10 AS noise").selectExpr("id", "a", "b", "label + noise AS label")
    texts = set()
    for placed in (df.coalesce(1), df.repartition(3, "b"), df.repartition(11)):
        found = models.fit_supervised(placed, "rf", ["a", "b"], "label", ["id"], {"maxDepth": [3]}, 2, numTrees=3)
        lines = models.tree_text(found.model).splitlines()[1:]
        texts.add("\n".join(x for x in lines if "Predict" not in x))
        parts = dealt(placed, ["id"])
        assert parts.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(texts) == 1


def test_a_fit_gives_up_its_shuffle_files(spark, tmp_path):
    """Factors are written every other iteration, and the shuffle files behind them go at once."""
    from minekit.operators import recommend

    rows = [(u, i, float((u * i) % 5)) for u in range(60) for i in range(u % 7, 60, 7)]
    ratings = spark.createDataFrame(rows, "user int, item int, rating float")
    als = recommend._als(maxIter=6, rank=2, seed=1)
    assert als.getCheckpointInterval() <= 2
    plain = als.copy({als.checkpointInterval: 10}).fit(ratings)
    cut = recommend.als_fit(ratings, max_iter=6, reg=0.1, rank=2, seed=1)
    got, want = ({r.id: list(r.features) for r in m.userFactors.collect()} for m in (cut, plain))
    assert got == want
