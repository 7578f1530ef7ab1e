"""Text operators: selection, exact de-duplication, tokens, vocabulary, document-term counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.functions import word_array
from minekit.operators.scale import checkpointed, number_rows, with_row_id


def dedup_with_id(
    df: DataFrame,
    text: str = "content",
    lang: str = "language",
    keep: str = "English",
    key: str | None = None,
) -> DataFrame:
    """``(id, value)``: distinct non-null texts of one language.

    Copies collapse map-side before the shuffle, so a text held by a third of all rows costs one
    row per map task. With ``key`` the id is the smallest key among the copies. Without it ids
    are generated and pinned by a checkpoint, so a lost executor cannot renumber the rows.
    """
    kept = df.where((F.col(lang) == keep) & F.col(text).isNotNull())
    if key is not None:
        return kept.groupBy(F.col(text).alias("value")).agg(F.min(key).alias("id")).select("id", "value")
    unique = kept.select(F.col(text).alias("value")).distinct()
    return with_row_id(unique, "id").select("id", "value")


def tokens(
    df: DataFrame,
    id_col: str = "id",
    text: str = "value",
    longer_than: int = 4,
    stop_words: str | Sequence[str] = "english",
) -> DataFrame:
    """``(id, value, words)``: the text kept beside its filtered words, in text order."""
    stop = (
        StopWordsRemover.loadDefaultStopWords(stop_words)
        if isinstance(stop_words, str)
        else list(stop_words)
    )
    stop = [w.lower() for w in stop]
    return df.where(F.col(text).isNotNull()).select(
        F.col(id_col).alias("id"),
        F.col(text).alias("value"),
        word_array(text, longer_than, stop).alias("words"),
    )


def token_rows(tok: DataFrame) -> DataFrame:
    """Long form ``(id, term)``, one row per occurrence."""
    return tok.select("id", F.explode("words").alias("term"))


def term_counts(tok: DataFrame) -> DataFrame:
    """Occurrences of each term in the corpus: ``(term, n)``."""
    return (
        tok.select(F.explode("words").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_terms(tok: DataFrame, k: int = 100) -> DataFrame:
    """The ``k`` most frequent terms, ties by term."""
    return term_counts(tok).orderBy(F.desc("n"), "term").limit(k)


def doc_terms(tok: DataFrame) -> DataFrame:
    """How often each term occurs in each document: ``(id, term, n)``."""
    return token_rows(tok).groupBy("id", "term").agg(F.count(F.lit(1)).alias("n"))


def vocabulary(tok: DataFrame, drop_top: int = 25) -> DataFrame:
    """``(idx, term)``: terms by falling frequency, the first ``drop_top`` left out, idx from 0."""
    return ranked_terms(term_counts(tok), drop_top)


def ranked_terms(counts: DataFrame, drop_top: int = 25) -> DataFrame:
    """``vocabulary`` from counted terms ``(term, n)``."""
    ranked = number_rows(counts, [F.desc("n"), F.asc("term")], "idx")
    return ranked.where(F.col("idx") >= drop_top).select(
        (F.col("idx") - F.lit(drop_top)).alias("idx"), "term"
    )


def doc_term_counts(tok: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, idx, n)``: how often each vocabulary term occurs in each document.

    Counted per document before the vocabulary join, so the join sees one row per distinct
    (document, term). The vocabulary is a table; it is never collected.
    """
    return doc_terms(tok).join(vocab, "term").select("id", "idx", "n")


def bag_of_words(tok: DataFrame, drop_top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Document-term counts ``(id, idx, n)`` and their vocabulary ``(idx, term)``.

    Texts are read and tokenised once: the counts per document are written, and the vocabulary
    is ranked by their sums.
    """
    terms = checkpointed(doc_terms(tok))
    vocab = checkpointed(ranked_terms(terms.groupBy("term").agg(F.sum("n").alias("n")), drop_top))
    return terms.join(vocab, "term").select("id", "idx", "n"), vocab


def doc_term_vectors(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """``(id, features)``: the counts as sparse ML vectors of vocabulary length.

    Assembled from the long form, so no driver-side vocabulary is needed. ``from_json`` is the
    built-in route from plain arrays to a sparse vector. Documents without any vocabulary term
    have no row; they carry no weight in a topic model.
    """
    size = vocab.agg(F.max("idx") + 1).scalar()
    sparse = F.lit(0).cast("tinyint")  # vector kind: 0 sparse, 1 dense
    entries = F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), "n")))
    features = F.to_json(
        F.struct(
            F.struct(
                sparse.alias("type"),
                size.cast("int").alias("size"),
                F.col("e.idx").alias("indices"),
                F.transform("e.n", lambda n: n.cast("double")).alias("values"),
            ).alias("features")
        )
    )
    schema = T.StructType([T.StructField("features", VectorUDT())])
    return (
        counts.groupBy("id")
        .agg(entries.alias("e"))
        .select("id", F.from_json(features, schema).alias("j"))
        .select("id", "j.features")
    )


def vector_entries(vectors: DataFrame) -> DataFrame:
    """``(id, idx, value)``: the stored entries of sparse vectors, the way back from ``doc_term_vectors``."""
    entries = "features struct<indices: array<int>, values: array<double>>"
    read = vectors.select("id", F.from_json(F.to_json(F.struct("features")), entries).alias("j"))
    zipped = F.arrays_zip("j.features.indices", "j.features.values")
    return read.select("id", F.inline(zipped).alias("idx", "value")).withColumn("idx", F.col("idx").cast("bigint"))
