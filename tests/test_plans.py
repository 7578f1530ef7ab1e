"""The end-to-end programs on small files written from the test tables or by hand."""

import random

import pytest
from pyspark.sql import functions as F

from minekit.catalog import tables
from minekit.operators.scale import scratch_path
from minekit.plans import baskets, housing, recommender, topics, trips
from minekit.sources import read_csv, write_csv
from minekit.sources.schemas import HOUSING_FILLS, HOUSING_NAMES, HOUSING_TYPES


def lines(spark, path):
    return [r.value.split("\t") for r in spark.read.text(path).collect()]


@pytest.fixture(scope="module")
def rating_files(spark):
    folder = scratch_path(spark, "ratings")
    rows = [(u, i, 5.0) for u in (1, 2, 3) for i in (10, 20)] + [(u, 30, 4.0) for u in (1, 2)]
    rows += [(4, 40, 4.5), (4, 50, 4.0), (5, 10, 1.0), (6, 20, 4.0)]
    write_csv(spark.createDataFrame(rows, "u int, i int, r double"), folder + "/ratings.csv", header=False)
    titles = [(10, "Ten"), (20, "Twenty, the"), (30, "Thirty"), (40, "Forty")]
    write_csv(spark.createDataFrame(titles, "i int, t string"), folder + "/items.csv", header=False)
    return folder + "/ratings.csv", folder + "/items.csv", folder


def test_basket_programs(spark, rating_files):
    ratings, items, out = rating_files
    got = lines(spark, baskets.pairs(spark, ratings, items, out))
    assert got[0] == ["10", "20", "Ten", "Twenty, the", "3"]
    assert ["40", "50", "Forty", "", "1"] in got and len(got) == 4
    stripes = dict(lines(spark, baskets.stripes(spark, ratings, items, out)))
    assert stripes["Ten"] == "Twenty, the:3;Thirty:2"
    rules = {tuple(r[:2]): r[2:] for r in lines(spark, baskets.confidence(spark, ratings, items, out))}
    assert rules == {
        ("Ten", "Twenty, the"): ["3", "3", "1.0"],
        ("Thirty", "Ten"): ["2", "2", "1.0"],
        ("Thirty", "Twenty, the"): ["2", "2", "1.0"],
    }
    lift = lines(spark, baskets.lift(spark, ratings, items, out))
    assert lift[0] == ["Forty", "", "11.0"]
    assert [float(r[2]) for r in lift] == sorted((float(r[2]) for r in lift), reverse=True)


def test_trip_chain(spark):
    rnd = random.Random(2)
    rows = []
    for _ in range(600):
        km = rnd.randrange(1, 30)
        minutes = km + rnd.randrange(0, 3)
        label = next((i + 1 for i, e in enumerate((5, 10, 15, 20, 30)) if minutes <= e), 6)
        rows.append((rnd.randrange(1, 5), minutes * 60, rnd.randrange(7), rnd.randrange(24), km, 0, 0, label))
    out = scratch_path(spark, "trips")
    names = "passenger_count trip_duration day_of_week timeOfDay dist_in_km rain_stat snow_stat duration_bin"
    write_csv(spark.createDataFrame(rows, names.split()), out + "/train")
    classes = trips.classify(spark, out + "/train", out, {"maxDepth": [3, 5]}, 3)
    report = {r.metric: float(r.value) for r in read_csv(spark, out + "/result").collect()}
    assert report["accuracy_train"] > 0.7 and report["accuracy_cv"] > 0.7
    routed = read_csv(spark, classes)
    assert routed.count() == 600
    assert {r.prediction for r in routed.select("prediction").distinct().collect()} <= set(range(1, 7))
    assert any("If (feature" in r.value for r in spark.read.text(out + "/tree").collect())
    predicted = trips.regress(spark, classes + "/prediction=5", out, {"regParam": [0.001]}, 3)
    assert predicted.endswith("regres-prediction=5")
    errors = {r.metric: float(r.value) for r in read_csv(spark, out + "/regress-result-prediction=5").collect()}
    assert 0 < errors["mae"] <= errors["rmse"] < 200


def test_topic_programs(spark, sf_dir):
    docs = tables.english(spark, sf_dir)
    language = F.when(F.col("lang") == "en", "English").otherwise("Other")
    blank = F.lit(None).cast("string")
    posts = docs.select(
        blank.alias("a1"), blank.alias("a2"), F.col("text").alias("content"),
        blank.alias("a4"), language.alias("language"), *[blank.alias(f"b{i}") for i in range(10)],
    )
    out = scratch_path(spark, "posts")
    write_csv(posts.repartition(3), out + "/in")
    prepared = topics.prepare(spark, out + "/in/*.csv", out + "/texts", multi_line=True)
    found = spark.read.parquet(prepared)
    assert found.columns == ["id", "value"]
    expected = {r.content for r in posts.where("language = 'English'").select("content").collect()}
    got = found.collect()
    assert {r.value for r in got} == expected
    assert len(got) == len(expected) == len({r.id for r in got})
    topics.model(spark, prepared, out, k=3, iterations=3)
    assert read_csv(spark, out + "/allTimeFreq").count() == 100
    assert read_csv(spark, out + "/allTopicsTerm").count() == 3 * 30
    assert read_csv(spark, out + "/topDocPerTopic", multi_line=True).count() == 3 * 20


def test_recommender_program(spark):
    rnd = random.Random(4)
    rows = [
        (u, i, float(max(1, min(5, 1 + (u * i) % 5))), 0)
        for u in range(40) for i in range(30) if rnd.random() < 0.6
    ]
    out = scratch_path(spark, "als")
    write_csv(spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long"), out + "/r")
    movies = spark.createDataFrame([(i, f"m{i}", "g") for i in range(25)], "movieId int, title string, genres string")
    write_csv(movies, out + "/m")
    recommender.recommend(spark, out + "/r", out + "/m", out, trials=[(3, 0.1), (5, 0.05)], folds=2)
    titles = [r.title for r in read_csv(spark, out + "/recommendations").collect()]
    assert len(titles) == 5 and all(t == "Empty" or t.startswith("m") for t in titles)
    assert read_csv(spark, out + "/foldPerformance").count() == 4
    final = {r.metric: float(r.value) for r in read_csv(spark, out + "/finalPerformance").collect()}
    assert set(final) == {"rmse", "mse", "map"} and 0 <= final["map"] <= 1


def test_housing_programs(spark):
    rnd = random.Random(6)
    cols = list(HOUSING_TYPES)
    rows = []
    for i in range(300):
        cells = [str(10_000 + i)]
        cells += [None if rnd.random() < 0.2 else f"{rnd.randrange(1, 50)}.0" for _ in cols[1:]]
        rows.append(tuple([*cells, "unused"]))
    out = scratch_path(spark, "housing")
    schema = ", ".join(f"{c} string" for c in [*cols, "extra"])
    write_csv(spark.createDataFrame(rows, schema), out + "/properties")
    labels = [(10_000 + i, (int(float(rows[i][4] or 7)) % 10) / 10.0, "2016-01-01") for i in range(0, 300, 2)]
    write_csv(spark.createDataFrame(labels, "parcelid long, logerror double, d string"), out + "/labels")
    housing.prepare(spark, out + "/properties", out + "/labels", out)
    everything = read_csv(spark, out + "/final_all")
    assert everything.columns == cols and everything.count() == 300
    assert everything.na.drop().count() == 300
    first_gap = next(r for r in rows if r[cols.index("fips")] is None)
    filled = everything.where(F.col("parcelid") == first_gap[0]).first()
    assert filled.fips == "6037" and len(HOUSING_FILLS) == 25 and len(HOUSING_NAMES) == 26
    assert read_csv(spark, out + "/final_joined").count() == 150
    profile = {r["column"]: r["n"] for r in read_csv(spark, out + "/profile").collect()}
    assert set(profile) == set(cols) and set(profile.values()) == {"300"}

    for kind, grid in (("dt", {"maxDepth": [3]}), ("rf", {"maxDepth": [3]}), ("gbt", {"maxIter": [2]})):
        housing.regress(spark, kind, out + "/final_joined", out, grid, 2)
        report = {r.metric: float(r.value) for r in read_csv(spark, f"{out}/{kind}-result").collect()}
        assert report["rows_before"] == report["rows_after"] == 150 and report["rmse"] > 0
    wide = read_csv(spark, housing.predict(spark, out + "/final_joined", out + "/final_all", out + "/wide"))
    assert wide.columns == ["ParcelId", *housing.MONTHS] and wide.count() == 300
    assert wide.where(F.col("201610") != F.col("201712")).count() == 0


def test_mode_imputation_option(spark):
    cols = list(HOUSING_TYPES)
    rows = [tuple(["1"] + ["5"] * 25), tuple(["2"] + ["5"] * 25), tuple(["3"] + [None] * 25)]
    out = scratch_path(spark, "modes")
    write_csv(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)), out + "/p")
    write_csv(spark.createDataFrame([(3, 0.1, "d")], "parcelid long, logerror double, d string"), out + "/l")
    housing.prepare(spark, out + "/p", out + "/l", out, impute="mode")
    joined = read_csv(spark, out + "/final_joined").first()
    assert joined.yearbuilt == "5" and float(joined.taxamount) == 5.0
