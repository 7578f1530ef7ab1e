"""Every registered query against its SQL on the smallest tables; fitted models by invariants."""

import pytest
from compare import connect, mismatch
from pyspark.sql import functions as F

import __spark_entry__ as entry
from minekit.catalog import tables

SQL = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry_has_rows(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["item_a", "item_b", "n", "freq_a", "freq_b", "lift"]
    assert df.limit(1).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert mismatch(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


@pytest.mark.parametrize("partitions", ["1", "3"])
@pytest.mark.parametrize("name", ["rule_lift", "item_stripes", "vocabulary", "map_score", "dense_keys"])
def test_results_do_not_depend_on_partitions(spark, sf_dir, con, name, partitions):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert mismatch(QUERIES[name](spark, sf_dir), con, SQL[name]) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def rows(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.mark.parametrize("name", ["linreg_cv"])
def test_regressions_beat_the_mean(spark, sf_dir, name):
    got = {r.metric: r.value for r in rows(spark, sf_dir, name)}
    assert set(got) == {"rmse", "mse", "mae"}
    amounts = tables.trips(spark, sf_dir)
    deviation = amounts.agg(F.stddev_pop("amount")).first()[0]
    assert 0 < got["mae"] <= got["rmse"] < deviation / 3


def test_cv_select_reports_every_setting_and_fold(spark, sf_dir):
    got = rows(spark, sf_dir, "cv_select")
    assert {(r.trial, r.fold) for r in got} == {(i, f) for i in range(3) for f in range(5)}
    best = {r.trial for r in got if r.best}
    assert best == {min((r.mean_rmse, r.trial) for r in got)[1]}


def test_model_report_shows_the_tree(spark, sf_dir):
    (row,) = rows(spark, sf_dir, "model_report")
    assert "If (feature" in row.text and "Predict:" in row.text


def test_segment_models_cover_the_predicted_classes(spark, sf_dir):
    got = rows(spark, sf_dir, "segment_models")
    assert {r.model for r in got} == {f"class-{k}" for k in range(1, 7)}
    assert {r.metric for r in got} == {"rmse", "mse", "mae"}
    assert all(0 <= r.value < 10 for r in got)


def test_als_recommendations_are_ranked(spark, sf_dir):
    got = rows(spark, sf_dir, "als_recommend")
    per_user = {}
    for r in sorted(got, key=lambda r: (r.user, r.rank)):
        per_user.setdefault(r.user, []).append(r)
    for recs in per_user.values():
        assert [r.rank for r in recs] == [1, 2, 3, 4, 5]
        assert [r.rating for r in recs] == sorted((r.rating for r in recs), reverse=True)
        assert len({r.item for r in recs}) == 5


def test_als_metrics(spark, sf_dir):
    got = {r.metric: r.value for r in rows(spark, sf_dir, "als_metrics")}
    assert set(got) == {"maxIter", "regParam", "n_train", "n_test", "rmse", "mse", "map"}
    assert got["rmse"] ** 2 == pytest.approx(got["mse"])
    assert 0 <= got["map"] <= 1


def test_lda_topics(spark, sf_dir):
    got = rows(spark, sf_dir, "lda_topics")
    assert len(got) == 5 * 30
    for topic in range(5):
        weights = [r.weight for r in sorted(got, key=lambda r: r["rank"]) if r.topic == topic]
        assert weights == sorted(weights, reverse=True) and len(weights) == 30


def test_lda_top_documents(spark, sf_dir):
    got = rows(spark, sf_dir, "lda_top_documents")
    assert len(got) == 5 * 20
    assert len({(r.topic, r.id) for r in got}) == 100
    assert all(0 <= r.weight <= 1 for r in got)
