import fixtures
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minekit.llm import encode, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(texts, path=PATH):
    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_counts_of_every_row(docs, tmp_path):
    got = token_counts.digest_columns(token_counts.count_tokens(docs, str(tmp_path / "c")), limit=20)
    data = fixtures.rows()
    want = sorted(
        tuple(map(repr, (r[0], len((r[1] or "").encode()), len(ids), len(ids) > 20)))
        for r, ids in zip(data, brute([r[1] for r in data]))
    )
    assert fixtures.pairs(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_second_run_encodes_only_new_texts(spark, docs, tmp_path):
    cache = str(tmp_path / "c")
    first = fixtures.pairs(token_counts.count_tokens(docs, cache), "doc_id", "n_tokens")
    stored = spark.read.parquet(cache)
    n = stored.count()
    assert n == len({r[1] or "" for r in fixtures.rows()}) == stored.select("digest").distinct().count()
    # a stored count is used as it stands, so it was not computed again
    other = str(tmp_path / "d")
    stored.withColumn("n_tokens", F.lit(-1).cast("long")).write.parquet(other)
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("a new text")))
    got = token_counts.count_tokens(more, other).collect()
    assert sorted(r.n_tokens for r in got)[-1] > 0 and sum(r.n_tokens == -1 for r in got) == len(first)
    assert spark.read.parquet(other).count() == n + 1
    # another version of the tokenizer shares nothing
    word = public_tokenizers.path("word_bpe_49k.json")
    token_counts.count_tokens(docs, other, word).collect()
    assert spark.read.parquet(other).count() == 2 * n + 1


def test_a_digest_that_two_jobs_appended(spark, docs, tmp_path):
    cache = str(tmp_path / "c")
    first = token_counts.count_tokens(docs, cache)
    want = fixtures.pairs(first, *first.columns)
    spark.read.parquet(cache).write.parquet(str(tmp_path / "same"))
    spark.read.parquet(str(tmp_path / "same")).write.mode("append").parquet(cache)
    again = token_counts.count_tokens(docs, cache)
    assert fixtures.pairs(again, *again.columns) == want


def test_empty_table(no_docs, tmp_path):
    assert token_counts.count_tokens(no_docs, str(tmp_path / "c")).collect() == []


@pytest.mark.parametrize("memo", [0, 5, 400_000])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoders_equal_the_library(spark, sf_dir, monkeypatch, memo, name):
    import numpy as np

    monkeypatch.setattr(encode, "MEMO_WORDS", memo)
    path = public_tokenizers.path(name)
    texts = [r[1] or "" for r in fixtures.rows()]
    texts += ["\n\nx  y\n z", " lead", "trail ", "a\n'sb 'll,'t", "$$$the&&& a***b!!", "1a2b 3.5%", "ÀÉ.ß×÷ªº", "a\x1fb\x85c"]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    want = brute(texts, path)
    if name.startswith("byte"):
        counter = encode.TokenCounter(path)
        assert [counter.count(t) for t in texts] == [len(ids) for ids in want]
    else:
        encoder = encode.WordEncoder(path)
        assert [np.frombuffer(encoder.encode(t), "<u4").tolist() for t in texts] == want
