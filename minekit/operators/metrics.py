"""Evaluation metrics as one-pass aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minekit.operators.ranking import topn_per_user


def hit_rate(label: str, prediction: str) -> Column:
    """Share of rows whose prediction equals the label, as an aggregate."""
    return F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0).cast("double"))


def root_mean_square(label: str, prediction: str) -> Column:
    """Root of the mean square error, as an aggregate."""
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    return F.sqrt(F.avg(err * err))


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Share of rows whose prediction equals the label: one row, ``accuracy``."""
    return df.agg(hit_rate(label, prediction).alias("accuracy"))


def regression_metrics(
    df: DataFrame, label: str = "label", prediction: str = "prediction"
) -> DataFrame:
    """One row with ``rmse``, ``mse`` and ``mae``."""
    err = F.col(label).cast("double") - F.col(prediction).cast("double")
    return df.agg(
        root_mean_square(label, prediction).alias("rmse"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
    )


def map_score(scored: DataFrame, relevant: DataFrame, n: int = 15) -> DataFrame:
    """Mean average precision of each user's ``n`` best-scored items: one row, ``map``.

    ``scored`` is ``(user, item, score)``, ``relevant`` is ``(user, item)``. Users count when they
    have at least one relevant and one scored item; precision is divided by the size of the
    user's relevant set.
    """
    known = F.col("user").isNotNull() & F.col("item").isNotNull()
    labels = relevant.where(known).select("user", "item").distinct()
    sizes = labels.groupBy("user").agg(F.count(F.lit(1)).alias("n_relevant"))
    ranked = topn_per_user(scored, n)
    by_rank = Window.partitionBy("user").orderBy("rank")
    hit = F.coalesce(F.col("hit"), F.lit(0))
    hits = (
        ranked.join(labels.withColumn("hit", F.lit(1)), ["user", "item"], "left")
        .withColumn("hit", hit)
        .withColumn("so_far", F.sum("hit").over(by_rank))
    )
    return (
        hits.groupBy("user")
        .agg(F.sum(F.col("hit") * F.col("so_far") / F.col("rank")).alias("gain"))
        .join(sizes, "user")
        .agg(F.avg(F.col("gain") / F.col("n_relevant")).alias("map"))
    )


def metrics_table(spark: SparkSession, rows: list[tuple[str, str, float]]) -> DataFrame:
    """A run report in long form: ``(model, metric, value)``."""
    return spark.createDataFrame(
        [(m, k, float(v)) for m, k, v in rows], "model string, metric string, value double"
    )


def metrics_long(df: DataFrame, model: str) -> DataFrame:
    """A one-row metrics frame in the long form of ``metrics_table``, staying lazy."""
    entries = [
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        for c in df.columns
    ]
    return df.select(F.explode(F.array(*entries)).alias("m")).select(
        F.lit(model).alias("model"), "m.metric", "m.value"
    )
