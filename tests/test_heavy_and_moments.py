"""Heavy hitters against full counts; regressions from moments against fits on the rows."""

import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from minekit.operators import heavy, moments, prep


def sample(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        skewed = "hot" if rng.random() < 0.33 else f"v{int(rng.paretovariate(0.7)) % 4000}"
        tied = f"t{i % 40}" if rng.random() < 0.9 else None
        rows.append((i, skewed, tied, i % 3, None))
    return spark.createDataFrame(rows, "id long, skewed string, tied string, few int, void string").repartition(5)


@pytest.mark.parametrize("tracked", [64, 4096])
@pytest.mark.parametrize("k", [1, 5, 50])
def test_heavy_hitters_equal_full_counts(spark, k, tracked):
    df = sample(spark)
    cols = ["id", "skewed", "tied", "few", "void"]
    key = lambda r: tuple(map(repr, r))
    got = sorted(map(tuple, heavy.heavy_hitters(df, cols, k, tracked).collect()), key=key)
    assert got == sorted(map(tuple, prep.value_frequency(df, cols, k).collect()), key=key)


def test_only_candidates_are_counted(spark):
    df = sample(spark)
    assert heavy.candidates(df, ["id"], 64).count() <= 65
    counts = heavy.counted(df, ["skewed"], 64)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    full = {r.value: r.n for r in prep.value_frequency(df, ["skewed"], 10**6).collect()}
    assert all(full[r.value] == r.n for r in counts.collect())


def test_no_rows(spark):
    empty = sample(spark).where("false")
    assert heavy.heavy_hitters(empty, ["id", "few"]).collect() == []


def planes(spark, n=3000):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + [5, 1000, 0]
    g = rng.integers(0, 3, n)
    y = x @ [2.0, -0.3, 5.0] * (g + 1) + 100 * g + rng.normal(size=n)
    rows = [(i, int(g[i]), *map(float, x[i]), 7.0, float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, a double, b double, c double, same double, y double").repartition(4)


FEATURES = ["a", "b", "c", "same"]


@pytest.mark.parametrize("reg, alpha", [(0.0, 0.0), (2.0, 0.0), (0.5, 0.5), (3.0, 1.0), (1000.0, 0.0)])
def test_fit_equals_a_fit_on_the_rows(spark, reg, alpha):
    df = planes(spark).where("g = 1")
    (row,) = moments.gathered(df.withColumn("fold", F.lit(0)), "g", FEATURES, "y").collect()
    co = np.zeros((5, 5))
    co[np.triu_indices(5)] = row["covariance"]
    co = (co + co.T - np.diag(np.diag(co))) * row["n"]
    coefficients, intercept = moments.fit(moments.Moments(row["n"], np.array(row["mean"]), co), reg, alpha)
    line = LinearRegression(featuresCol="x", labelCol="y", regParam=reg, elasticNetParam=alpha, maxIter=500, tol=1e-12)
    model = line.fit(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(df))
    assert np.allclose(coefficients, model.coefficients.toArray(), rtol=2e-3, atol=2e-3)
    assert abs(intercept - model.intercept) < 2e-3 * max(1, abs(model.intercept))


def test_search_equals_fits_on_the_folds(spark):
    df = planes(spark)
    settings = [(5.0, 0.0), (0.0, 0.0), (1.0, 1.0)]
    trials, models = moments.search(df, "g", FEATURES, "y", ["id"], settings, folds=4)
    got = {(r.group, r.reg, r.fold): r.rmse for r in trials.collect()}
    assert len(got) == 3 * 3 * 4
    rows = prep.with_fold(df, ["id"], 4).collect()
    for g, fold in ((0, 1), (2, 3)):
        train = np.array([[*(r[f] for f in FEATURES), 1.0, r.y] for r in rows if r.g == g and r.fold != fold])
        test = np.array([[*(r[f] for f in FEATURES), 1.0, r.y] for r in rows if r.g == g and r.fold == fold])
        w = np.linalg.lstsq(train[:, :-1], train[:, -1], rcond=None)[0]
        assert abs(got[g, 0.0, fold] - np.sqrt(np.mean((test[:, :-1] @ w - test[:, -1]) ** 2))) < 1e-6
    assert {(r.group, r.reg) for r in trials.where("best").collect()} == {(g, 0.0) for g in range(3)}
    scored = moments.scored(df, "g", models, FEATURES)
    assert scored.columns == [*df.columns, "prediction"]
    assert scored.agg(F.sqrt(F.avg((F.col("prediction") - F.col("y")) ** 2))).first()[0] < 1.1


def test_one_scan_for_all_folds_and_settings(spark):
    df = prep.with_fold(planes(spark), ["id"], 4)
    plan = moments.gathered(df, "g", FEATURES, "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and plan.count("Exchange hashpartitioning") == 1


def test_rows_with_gaps_and_constant_labels(spark):
    rows = [(i, 0, 1.0 * i, 4.0) for i in range(20)] + [(20, 0, None, 9.0), (21, 0, 2.0, None), (22, 1, float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "id long, g int, x double, y double")
    trials, models = moments.search(df, "g", ["x"], "y", ["id"], [(0.0, 0.0)], 3)
    assert {(r.group, r.term): r.coefficient for r in models.collect()} == {(0, "x"): 0.0, (0, "intercept"): 4.0}
    assert trials.where("rmse > 1e-9").isEmpty()


def test_a_group_in_one_fold_has_no_error(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 2.0)], "id long, g int, x double, y double")
    trials, models = moments.search(df, "g", ["x"], "y", ["id"], [(1.0, 0.0), (0.0, 0.0)], 3)
    assert [(r.rmse, r.best) for r in trials.collect()] == [(None, True), (None, False)]
    assert models.where("term = 'intercept'").first().coefficient == 2.0
