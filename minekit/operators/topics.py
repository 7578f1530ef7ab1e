"""LDA topics, their top terms and top documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minekit.operators import topic_counts, topic_mixtures
from minekit.operators.scale import checkpoint_root


@dataclass(frozen=True)
class EmModel:
    """Topics by EM, with the two methods of ``LDAModel`` that the reports need."""

    counts: topic_counts.TopicCounts

    def describeTopics(self, maxTermsPerTopic: int = 10) -> DataFrame:
        """``(topic, termIndices, termWeights)``: found in the table of terms, none of it on the driver."""
        totals = F.array(*[F.lit(total) for total in self.counts.totals])
        weights = self.counts.terms.select(
            "idx", F.posexplode(F.zip_with("counts", totals, lambda n, total: n / total)).alias("topic", "weight")
        )
        order = Window.partitionBy("topic").orderBy(F.desc("weight"), "idx")
        heavy = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= maxTermsPerTopic)
        entries = F.array_sort(F.collect_list(F.struct("rank", "idx", "weight")))
        return heavy.groupBy("topic").agg(entries.alias("e")).select(
            "topic", F.col("e.idx").alias("termIndices"), F.col("e.weight").alias("termWeights")
        )

    def transform(self, dataset: DataFrame) -> DataFrame:
        """``dataset`` with ``topicDistribution``, as Spark's own model infers it from the counts."""
        return topic_mixtures.mixtures(dataset, self.counts)


def fit_lda(
    vectors: DataFrame,
    k: int = 5,
    max_iter: int = 20,
    optimizer: str = "em",
    seed: int = 12345,
    checkpoint_interval: int = 10,
) -> LDAModel | EmModel:
    """Fit LDA on ``(id, features)``; pass a checkpointed frame, the fit leans on it."""
    checkpoint_root(vectors.sparkSession)
    if optimizer == "em":
        return EmModel(topic_counts.fit(vectors, k, max_iter, seed, checkpoint_interval))
    lda = LDA(
        k=k,
        maxIter=max_iter,
        optimizer=optimizer,
        seed=seed,
        featuresCol="features",
        checkpointInterval=checkpoint_interval,
    )
    return lda.fit(vectors)


def topic_terms(model: LDAModel | EmModel, vocab: DataFrame, n: int = 30) -> DataFrame:
    """``(topic, rank, term, weight)``: the ``n`` heaviest terms of each topic."""
    # k * n rows at most, hence the broadcast
    heavy = model.describeTopics(n).select(
        F.col("topic").cast("bigint").alias("topic"),
        F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("pos", "t"),
    )
    picks = heavy.select(
        "topic",
        (F.col("pos") + 1).cast("bigint").alias("rank"),
        F.col("t.termIndices").cast("bigint").alias("idx"),
        F.col("t.termWeights").alias("weight"),
    )
    return vocab.join(F.broadcast(picks), "idx").select("topic", "rank", "term", "weight")


def top_documents(
    model: LDAModel | EmModel, vectors: DataFrame, docs: DataFrame, n: int = 20
) -> DataFrame:
    """``(topic, rank, id, value, weight)``: the ``n`` documents with the most weight per topic."""
    mixture = model.transform(vectors).select(
        "id", F.posexplode(vector_to_array("topicDistribution")).alias("topic", "weight")
    )
    order = Window.partitionBy("topic").orderBy(F.desc("weight"), "id")
    best = (
        mixture.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= n)
        .withColumn("topic", F.col("topic").cast("bigint"))
    )
    # k * n rows at most, hence the broadcast
    return docs.select("id", "value").join(F.broadcast(best), "id").select(
        "topic", "rank", "id", "value", "weight"
    )
