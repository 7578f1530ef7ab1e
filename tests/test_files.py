import pytest

from minekit import sources
from minekit.operators.scale import scratch_path


def test_single_file_report_and_prefix_schema(spark):
    df = spark.createDataFrame([(1, "a,b", 2.5), (2, None, None)], "id long, t string, x double")
    path = scratch_path(spark, "report")
    sources.write_csv(df, path, single_file=True)
    assert spark.read.format("binaryFile").load(path + "/*.csv").count() == 1
    back = sources.read_csv(spark, path, "key long, label string")
    assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]


def test_single_file_runs_its_input_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(len(batch))
            yield batch

    df = spark.range(40).mapInPandas(counted, "id long")
    sources.write_csv(df, scratch_path(spark, "once"), single_file=True)
    assert rows.value == 40


def test_existing_output_is_an_error(spark):
    path = scratch_path(spark, "twice")
    sources.write_csv(spark.range(1), path)
    with pytest.raises(Exception, match="(?i)exist"):
        sources.write_csv(spark.range(1), path)


def test_headerless_text_roundtrip(spark):
    path = scratch_path(spark, "text")
    sources.write_text(spark.createDataFrame([(1, None, 4.0)], "a int, b string, c double"), path)
    assert [tuple(r) for r in sources.read_headerless(spark, path).collect()] == [("1", None, "4.0")]


def test_routing_reads_one_class(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0)], "id long, prediction double")
    path = scratch_path(spark, "routed")
    sources.write_routed(df, path, fmt="csv")
    got = sources.read_routed(spark, path, 2.0, fmt="csv")
    assert {r.id for r in got.collect()} == {"2", "3"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prediction" in plan


def test_output_path():
    assert sources.output_path("/out/", "pairs-", "/data/in/ratings.csv") == "/out/pairs-ratings.csv"


def test_awkward_text_survives(spark):
    texts = ['say "hi", twice', "two\nlines", "back\\slash", 'ends with \\', '"quoted"', "comma,"]
    path = scratch_path(spark, "awkward")
    sources.write_csv(spark.createDataFrame([(t,) for t in texts], "t string"), path)
    got = sources.read_csv(spark, path, "t string", multi_line=True).collect()
    assert sorted(r.t for r in got) == sorted(texts)
