"""The pipeline: stages chained as the driver chains them, each decision seen in what is left."""

import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_near_copies import brute_survivors
from test_secret_scan import base

import corpus_pipeline
from minekit.llm.common import documents, written

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    # beside the given rows: texts without letters, and copies
    docs = documents(spark, DATA)
    more = docs.where("doc_id = 1").withColumn("doc_id", F.lit(10_001).cast("long"))
    odd = more.withColumn("doc_id", F.lit(10_002).cast("long")).withColumn("text", F.lit("1 2 3. " * 80))
    out = [written(docs.unionByName(more).unionByName(odd), "pipeline-test")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], DATA), f"test-{name}"))
    return out


def test_stages_keep_the_columns(results):
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "language_id", "near_dedup", "secret_scans", "best_fit_packing",
    ]
    for df in results[1:-1]:
        assert df.dtypes == results[0].dtypes


def test_quality_keeps_good_documents(spark, results):
    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1")
    good = results[0].join(labels, "doc_id").count()
    assert results[1].join(labels, "doc_id").count() >= 0.97 * good
    assert results[1].count() < results[0].count()


def test_language_rejects_texts_without_letters(results):
    assert results[2].where(~F.col("text").rlike(r"\p{L}")).count() == 0
    assert results[2].count() == results[1].where(F.col("text").rlike(r"\p{L}")).count()


def test_one_document_of_each_group(results):
    rows = results[2].select("doc_id", "text").collect()
    assert sorted(r.doc_id for r in results[3].collect()) == brute_survivors([(r.doc_id, r.text or "") for r in rows])


def test_no_secret_of_one_owner_is_left(results):
    before = {r.doc_id: r.text for r in results[3].collect()}
    after = {r.doc_id: r for r in results[4].collect()}
    assert set(before) == set(after)
    for key, r in after.items():
        assert not base(r.text) and r.n_chars == len(r.text)
        if not base(before[key]):
            assert r.text == before[key]


def test_all_texts_are_packed(results):
    packed = results[5].collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in results[4].collect()}
    assert all(r.offset + r.length <= 4096 for r in packed)


def test_run_equals_its_stages(spark):
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    rows = got.collect()
    assert len(rows) > 100 and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


def test_language_model_decides(spark, results):
    docs = results[1]
    one = docs.where("text rlike '[a-z]'").limit(1)
    odd = {
        20_001: "qzxj wvkq xzzq jjqk vvwx " * 40,
        20_002: "это другой язык который никто не учил " * 20,
        20_003: "中文字符没有空格这是另一种语言" * 20,
    }
    more = docs
    for key, text in odd.items():
        row = one.withColumn("doc_id", F.lit(key).cast("long")).withColumn("lang", F.lit(None).cast("string"))
        more = more.unionByName(row.withColumn("text", F.lit(text)))
    kept = {r.doc_id for r in corpus_pipeline.language_id(spark, more, DATA).select("doc_id").collect()}
    assert kept == {r.doc_id for r in results[2].select("doc_id").collect()}


def test_no_language_to_learn_keeps_what_has_letters(spark, results):
    docs = results[1].withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language_id(spark, docs, DATA)
    assert kept.count() == docs.where(F.col("text").rlike(r"\p{L}")).count() > 100


def test_columns_with_clashing_names_come_back(spark):
    docs = documents(spark, DATA)
    names = ["secrets", "_score", "_language", "_row_key", "_text_digest", "_found_secrets", "_secrets", "a.b", "key"]
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.dtypes == docs.dtypes
        quoted = [F.col(f"`{n}`") for n in names]
        bad = [c != F.concat(F.lit(n), F.col("doc_id").cast("string")) for n, c in zip(names, quoted)]
        assert out.where(F.exists(F.array(*bad), lambda x: x)).isEmpty() and not out.isEmpty()
