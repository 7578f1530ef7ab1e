import random
import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest

from minekit.llm import queries, segmentation

PATH = public_tokenizers.path(segmentation.MODEL)


@pytest.fixture(scope="module")
def model():
    return segmentation.Pieces(PATH)


def brute(model, text):
    """Scores of all segmentations of a whole short text, best first."""
    s = segmentation.BLANK + text.replace(" ", segmentation.BLANK)
    edges = model.edges(s)
    scores = [[0]]
    for here in edges[1:]:
        scores.append([x + score for i, score, _ in here for x in scores[i]])
    return sorted((x / 1000 for x in scores[-1]), reverse=True)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_scores_equal_brute_force_over_whole_texts(model, n):
    rng = random.Random(n)
    texts = ["a", "the cat", "  x", "a\nb", "don't", "né 中", "Stop!!", "abcab cab", "ał ść.b", "▁q"]
    texts += ["".join(rng.choice("abe n.\né") for _ in range(rng.randint(1, 11))) for _ in range(40)]
    for text in texts:
        got = model.segmentations(text, n)
        assert [s for s, _ in got] == pytest.approx(brute(model, text)[:n]), text
        assert len({ids for _, ids in got}) == len(got)
        for score, ids in got:
            assert model.decode(ids) == text.replace(segmentation.BLANK, " ")


def test_every_row(docs, model):
    data = fixtures.rows()
    want = []
    for r in data:
        text = r[1] or ""
        for rank, (score, ids) in enumerate(model.segmentations(text, 3), start=1):
            want.append(tuple(map(repr, (r[0], rank, score, len(ids) // 4, zlib.crc32(ids), True))))
    found = segmentation.n_best(docs)
    assert fixtures.pairs(found, "doc_id", "rank", "score", "n_pieces", "ids_crc32", "restored") == sorted(want)
    texts = {repr(r[1] or "") for r in data}
    assert {repr(r.text) for r in segmentation.decoded(found.drop("text")).collect()} == texts


def test_best_is_at_least_as_good_as_the_library(spark, sf_dir, model):
    """The library merges greedily; its pieces are a path of the lattice, so never above the best."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    score = {i: s for s, i in model.piece.values()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(20).collect():
        ids = library.encode(r.text)
        if all(i in score for i in ids):
            best, second = model.segmentations(r.text, 2)
            assert best[0] >= second[0] and best[0] >= sum(score[i] for i in ids) / 1000


def test_long_runs_stay_cheap(model):
    (a, x), (b, y) = model.segmentations("x" * 20_000, 2)
    assert a >= b and model.decode(x) == model.decode(y) == "x" * 20_000
    assert np.frombuffer(x, "<u4").size > 1000


def test_the_query_gives_the_ids_of_every_rank(spark, tmp_path, model):
    rows = [(1, "the cat sat"), (2, "né 中 x"), (3, f"a{segmentation.BLANK}b"), (4, None), (4, "the cat sat")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op2_n_best(spark, str(tmp_path)).collect()
    want = {(d, rank, ids) for d, t in rows for rank, (_, ids) in enumerate(model.segmentations(t or "", 3), 1)}
    assert {(r.doc_id, r["rank"], bytes(r.ids)) for r in got} == want and len(got) == 13
    texts = {d: t or "" for d, t in rows if d != 4}
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.n_pieces
        if r.doc_id in texts:
            assert (model.decode(bytes(r.ids)) == texts[r.doc_id]) == r.restored


def test_the_best_path_alone_is_that_of_the_search(model):
    rng = random.Random(5)
    words = ["a", "\n", "▁▁", "▁the", "ß漢", "unpiecelikeword", "abababab"]
    words += ["".join(rng.choice("ab▁ée.,1漢") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    for word in words:
        every = model.best(word, 3)
        lost = every[0][0] - every[1][0] if len(every) > 1 else float("inf")
        assert model.first(word) == (every[0][0], lost, every[0][1]), word


def test_empty_table(no_docs):
    assert segmentation.n_best(no_docs).collect() == []
