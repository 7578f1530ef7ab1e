import random

import pytest
from pyspark.ml.evaluation import RankingEvaluator
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from minekit.operators import metrics, ranking, text


def words(spark, value, **options):
    df = spark.createDataFrame([(1, value)], "id long, value string")
    rows = text.tokens(df, **options).collect()
    return rows[0].words if rows else None


@pytest.mark.parametrize(
    "value, expected",
    [
        ("The  Election, results about Russia 2016", ["results", "russia"]),
        ("ABOUT Themselves", []),
        ("five\tletters\nhere\x0bcount", ["letters", "count"]),
        ("über straße Россия", ["straße", "россия"]),
        ("tail\u0085 words\u0085", []),
        ("", []),
        (None, None),
    ],
)
def test_tokens(spark, value, expected):
    assert words(spark, value) == expected


def test_tokens_options(spark):
    assert words(spark, "one three seven", longer_than=2, stop_words=["SEVEN"]) == ["one", "three"]


def test_long_texts_are_read_to_the_end(spark):
    assert words(spark, "noise " * 50_000 + "finale")[-1] == "finale"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, "apple apple banana cherry"),
        (2, "banana apple grape grape grape"),
        (3, "x y z"),
    ]
    return text.tokens(spark.createDataFrame(rows, "id long, value string"))


def test_vocabulary_and_counts(corpus):
    assert [(r.term, r.n) for r in text.top_terms(corpus, 2).collect()] == [("apple", 3), ("grape", 3)]
    vocab = text.vocabulary(corpus, drop_top=1)
    assert {r.idx: r.term for r in vocab.collect()} == {0: "grape", 1: "banana", 2: "cherry"}
    counts = text.doc_term_counts(corpus, vocab)
    assert {tuple(r) for r in counts.collect()} == {(1, 1, 1), (1, 2, 1), (2, 0, 3), (2, 1, 1)}
    vectors = {r.id: r.features for r in text.doc_term_vectors(counts, vocab).collect()}
    assert vectors == {1: SparseVector(3, {1: 1, 2: 1}), 2: SparseVector(3, {0: 3, 1: 1})}


def test_dropping_more_terms_than_there_are(corpus):
    assert text.vocabulary(corpus).count() == 0


def test_dedup(spark):
    rows = [(5, "a", "English"), (3, "a", "English"), (4, "b", "French"), (6, None, "English"), (7, "c", None)]
    df = spark.createDataFrame(rows, "k long, content string, language string")
    assert [tuple(r) for r in text.dedup_with_id(df, key="k").collect()] == [(3, "a")]
    df = df.union(spark.createDataFrame([(8, "d", "English")], df.schema))
    got = text.dedup_with_id(df).collect()
    assert sorted(r.value for r in got) == ["a", "d"] and len({r.id for r in got}) == 2


@pytest.fixture(scope="module")
def scored(spark):
    rnd = random.Random(1)
    rows = [(u, i, rnd.choice([1.0, 2.5, 3.0, 5.0]), rnd.random()) for u in range(20) for i in range(30)]
    rows += [(99, i, 1.0, rnd.random()) for i in range(5)]  # nothing relevant
    return spark.createDataFrame(rows, "user long, item long, rating double, score double")


def test_relevance_is_strict(scored):
    assert scored.join(ranking.relevant_items(scored), ["user", "item"]).where("rating <= 2.5").count() == 0
    whole = ranking.relevant_sets(scored, max_items=4).groupBy("user").agg(F.sum(F.size("items")).alias("n"))
    assert {r.user: r.n for r in whole.collect()} == {
        r.user: r["count"] for r in ranking.relevant_items(scored).groupBy("user").count().collect()
    }


def test_map_agrees_with_the_ranking_evaluator(scored):
    relevant = ranking.relevant_items(scored)
    lists = ranking.ranked_lists(scored, 15).select("user", F.col("items").cast("array<double>").alias("prediction"))
    labels = relevant.groupBy("user").agg(F.collect_set(F.col("item").cast("double")).alias("label"))
    expected = RankingEvaluator(metricName="meanAveragePrecision").evaluate(lists.join(labels, "user"))
    assert metrics.map_score(scored, relevant, 15).first()["map"] == pytest.approx(expected)


def test_topn_breaks_ties_by_item(spark):
    df = spark.createDataFrame([(1, 3, 0.5), (1, 2, 0.5), (1, 9, 0.9)], "user long, item long, score double")
    got = [(r.item, r["rank"]) for r in ranking.topn_per_user(df, 2).orderBy("rank").collect()]
    assert got == [(9, 1), (2, 2)]


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0)], "label double, prediction double")
    got = metrics.regression_metrics(df).first()
    assert (got.mse, got.mae, got.rmse) == (0.5, 0.5, pytest.approx(0.5**0.5))
    assert metrics.accuracy(df).first().accuracy == 0.5
