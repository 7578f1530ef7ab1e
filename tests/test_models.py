import random

import pytest
from pyspark.sql import functions as F

from minekit.operators import models, recommend
from minekit.operators.scale import spread

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def planted(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(800):
        a, b = rnd.uniform(0, 10), rnd.uniform(0, 10)
        rows.append((i, a, b, 3 * a - 2 * b + 5 + rnd.gauss(0, 0.1), int(a > 5) + 1))
    return spark.createDataFrame(rows, "id long, a double, b double, y double, cls int")


def test_linear_search_picks_the_weak_penalty_and_recovers_the_plane(planted):
    found = models.fit_supervised(planted, "linear", FEATURES, "y", ["id"], folds=3)
    assert found.best["regParam"] == 0.001
    stage = found.model.stages[-1]
    assert list(stage.coefficients) == pytest.approx([3, -2], abs=0.05)
    assert found.trials.count() == 4 * 3
    assert found.trials.where("best").select("trial").distinct().count() == 1


@pytest.mark.parametrize("kind, grid", [("dt", {"maxDepth": [5]}), ("rf", {"maxDepth": [5]}), ("gbt", {"maxIter": [5]})])
def test_trees_beat_the_mean(planted, kind, grid):
    found = models.fit_supervised(planted, kind, FEATURES, "y", ["id"], grid, folds=2)
    deviation = planted.agg(F.stddev_pop("y")).first()[0]
    assert found.trials.first().mean_rmse < deviation / 2


def test_classifier_ties_go_to_the_first_setting(planted):
    found = models.fit_supervised(planted, "dt_class", FEATURES, "cls", ["id"], {"maxDepth": [2, 4]}, 2)
    means = [r.mean_accuracy for r in found.trials.orderBy("trial").collect()]
    assert found.best["maxDepth"] == (2 if means[0] >= means[-1] else 4)


def test_segments_get_their_own_line(spark):
    rows = [(1, float(x), 2.0 * x + 1) for x in range(10)] + [(2, float(x), -1.0 * x) for x in range(10)]
    df = spark.createDataFrame(rows, "seg int, x double, y double")
    got = {r.seg: (r.slope, r.intercept) for r in models.segment_regression(df, "seg", "x", "y").collect()}
    assert got[1] == pytest.approx((2, 1)) and got[2] == pytest.approx((-1, 0))


def test_null_features_are_an_error(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0), (2, 1.0, 2.0, 3.0)], "id long, a double, b double, y double")
    with pytest.raises(Exception):
        models.fit_all(df, "linear", FEATURES, "y")


def test_spread_fills_the_cores_and_keeps_rows(spark):
    one = spread(spark.range(100).coalesce(1))
    assert one.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in one.collect()) == list(range(100))
    one.unpersist()


def test_ids_beyond_int_are_numbered_and_restored(spark):
    big = 10**12
    rows = [(big + u, i, float(1 + (u + i) % 5)) for u in range(12) for i in range(8)]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    indexed, keys = recommend.int_ids(ratings)
    assert set(keys) == {"user"} and dict(indexed.dtypes)["user"] == "int"
    model = recommend.als_fit(indexed, max_iter=3)
    titles = spark.createDataFrame([(0, "zero")], "item long, title string")
    asked = ratings.where(F.col("user") == big + 3).select("user").distinct()
    got = recommend.recommend(model, titles, asked, keys=keys).collect()
    assert {r.user for r in got} == {big + 3} and sorted(r["rank"] for r in got) == [1, 2, 3, 4, 5]
    assert all(r.title == ("zero" if r.item == 0 else "Empty") for r in got)
    everyone = recommend.recommend(model, titles, keys=keys)
    assert everyone.select("user").distinct().count() == 12
