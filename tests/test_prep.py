import pytest
from pyspark.sql import functions as F

from minekit.functions import duration_bin, number_from_text, whole_number
from minekit.operators import prep
from minekit.operators.scale import in_parts, number_rows


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2.0", 2), ("06037", 6037), ("2.9", 2), ("-3", -3), ("+4", 4), (" 5 ", 5), ("6.", 6),
        ("9007199254740993", 9007199254740993), ("1e3", 1000), ("1.2E7", 12000000), (".5", 0), ("-1.5e1", -15),
        ("6.0379203391054E13", 60379203391054), ("1e30", None), ("", None), ("abc", None),
        ("1.2.3", None), ("7\n8", None), ("99999999999999999999", None), (None, None),
    ],
)
def test_whole_number(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(whole_number("t")).first()[0] == expected


@pytest.mark.parametrize(
    "text, expected",
    [("345.72", 345.72), ("-1e3", -1000.0), (".5", 0.5), ("x", None), ("1.0f", None), (None, None)],
)
def test_number_from_text(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(number_from_text("t")).first()[0] == expected


def test_duration_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 5, 6, 10, 15, 20, 30, 31, None)], "m int")
    got = [r[0] for r in df.select(duration_bin("m")).collect()]
    assert got == [1, 1, 2, 2, 3, 4, 5, 6, None]


@pytest.fixture(scope="module")
def gaps(spark):
    rows = [(1, "a", 5), (2, "a", None), (3, "b", 5), (4, None, 7), (5, None, None), (6, None, 7)]
    return spark.createDataFrame(rows, "id long, c string, k int")


def test_modes_ignore_nulls_and_break_ties_by_value(gaps):
    got = {r["column"]: (r["value"], r["n"]) for r in prep.column_modes(gaps, ["c", "k"]).collect()}
    assert got == {"c": ("a", 2), "k": ("5", 2)}


def test_value_frequency_counts_nulls(gaps):
    got = [(r["column"], r["value"], r["n"]) for r in prep.value_frequency(gaps, ["c"], 2).collect()]
    assert sorted(got, key=str) == sorted([("c", None, 3), ("c", "a", 2)], key=str)


def test_impute_mode_keeps_types(gaps):
    out = prep.impute_mode(gaps, ["c", "k"])
    assert out.schema == gaps.schema
    assert [tuple(r) for r in out.orderBy("id").collect()] == [
        (1, "a", 5), (2, "a", 5), (3, "b", 5), (4, "a", 7), (5, "a", 5), (6, "a", 7)
    ]


def test_impute_mode_of_an_empty_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, c string")
    assert [r.c for r in prep.impute_mode(df, ["c"]).collect()] == [None, None]


def test_impute_constant_reads_text_constants(gaps):
    out = prep.impute_constant(gaps, {"c": "x", "k": "2.0"})
    assert {(r.c, r.k) for r in out.where("id = 5").collect()} == {("x", 2)}


def test_profile_and_drop_agree(gaps):
    profile = {r["column"]: r for r in prep.null_profile(gaps, ["id", "c", "k"]).collect()}
    assert (profile["c"]["n"], profile["c"]["n_null"]) == (3, 3)
    assert profile["k"]["mean"] == 6.0 and profile["c"]["mean"] is None
    report = prep.drop_report(gaps).first()
    assert (report.rows_before, report.rows_after) == (6, prep.drop_nulls(gaps).count()) == (6, 2)


def test_feature_table_renames_by_position(spark):
    left = spark.createDataFrame([(1, 10), (2, 20)], "k long, a int")
    right = spark.createDataFrame([(1, 0.5), (3, 0.1)], "k long, y double")
    out = prep.feature_table(left, right, "k", ["k", "a", "y"], ["id", "area", "target"])
    assert out.columns == ["id", "area", "target"]
    assert [tuple(r) for r in out.collect()] == [(1, 10, 0.5)]


def test_split_is_a_partition_and_stable(spark):
    df = spark.range(5000)
    train, test = prep.hash_split(df, ["id"], 0.8)
    assert train.count() + test.count() == 5000
    assert train.join(test, "id").count() == 0
    assert abs(train.count() - 4000) < 150
    again, _ = prep.hash_split(df.repartition(7), ["id"], 0.8)
    assert {r.id for r in again.collect()} == {r.id for r in train.collect()}
    other, _ = prep.hash_split(df, ["id"], 0.8, seed="b")
    assert {r.id for r in other.collect()} != {r.id for r in train.collect()}


def test_rows_without_a_key_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    for keys in (["k"], ["k", "v"]):
        train, test = prep.hash_split(df, keys, 0.5)
        assert train.count() + test.count() == 3
        assert prep.with_fold(df, keys, 3).where("fold is null").count() == 0


def test_folds_cover_everything_once(spark):
    df = prep.with_fold(spark.range(1000), ["id"], 5)
    assert sum(prep.fold_test(df, i).count() for i in range(5)) == 1000
    for r in prep.fold_sizes(df).collect():
        assert r.n_test + r.n_train == 1000
        assert r.n_train == prep.fold_train(df, r.fold).count()


def test_number_rows_is_dense_and_ordered(spark):
    df = spark.range(997).select(((F.col("id") * 37) % 997).alias("v"), (F.col("id") % 3).alias("g"))
    got = number_rows(df, [F.desc("g"), F.asc("v")], "i").collect()
    expected = sorted(((r.g, r.v) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r.g, r.v) for r in sorted(got, key=lambda r: r.i)] == expected
    assert sorted(r.i for r in got) == list(range(997))


def test_number_rows_of_nothing(spark):
    assert number_rows(spark.range(0), [F.asc("id")]).count() == 0


def test_in_parts_splits_only_large_groups(spark):
    df = spark.range(100).select(F.when(F.col("id") < 90, 0).otherwise(F.col("id")).alias("g"), "id")
    got = in_parts(df, "g", "id", 20).collect()
    assert len(got) == 100
    assert {r.parts for r in got if r.g == 0} == {5}
    assert len({r.part for r in got if r.g == 0}) > 1
    assert {(r.parts, r.part) for r in got if r.g != 0} == {(1, 0)}


def test_mode_ties_go_to_the_smallest_number(spark):
    rows = [(9, "9"), (10, "10"), (9, "9"), (10, "10"), (None, None)]
    df = spark.createDataFrame(rows, "k long, c string")
    got = {r.column: r.value for r in prep.column_modes(df, ["k", "c"]).collect()}
    assert got == {"k": "9", "c": "10"}
