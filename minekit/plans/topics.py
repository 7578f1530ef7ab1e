"""Posts: prepare English texts, then fit and describe topics."""

from __future__ import annotations

from pyspark.sql import SparkSession

from minekit.operators import text, topics
from minekit.operators.scale import checkpointed, dealt
from minekit.sources import read_csv, write_csv
from minekit.sources.schemas import DOCUMENTS, POSTS


def prepare(spark: SparkSession, posts_glob: str, out: str, multi_line: bool = False) -> str:
    """Distinct English contents of all matching files as a Parquet table ``(id, value)``.

    Files are read by lines and split among tasks. Contents with line breaks need ``multi_line``, which
    reads each file in one task.
    """
    text.dedup_with_id(read_csv(spark, posts_glob, POSTS, multi_line=multi_line)).write.parquet(out)
    return out


def model(spark: SparkSession, docs_path: str, out_dir: str, k: int = 5, iterations: int = 20) -> str:
    """Top 100 terms of the corpus, top 30 terms and top 20 documents per topic."""
    docs = spark.read.schema(DOCUMENTS).parquet(docs_path)
    tok = text.tokens(docs)
    counts, vocab = text.bag_of_words(tok)
    vectors = checkpointed(dealt(text.doc_term_vectors(counts, vocab), ["id"]))
    lda = topics.fit_lda(vectors, k, iterations)
    terms = topics.topic_terms(lda, vocab).orderBy("topic", "rank")
    best = topics.top_documents(lda, vectors, docs).orderBy("topic", "rank")
    write_csv(text.top_terms(tok), f"{out_dir}/allTimeFreq", single_file=True)
    write_csv(terms, f"{out_dir}/allTopicsTerm", single_file=True)
    write_csv(best, f"{out_dir}/topDocPerTopic", single_file=True)
    return out_dir
