"""Ratings: search and fit ALS, report its errors, recommend for one user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from minekit.operators import metrics, ranking
from minekit.operators import recommend as als
from minekit.operators.prep import hash_split, typed_projection
from minekit.operators.scale import checkpointed
from minekit.sources import read_csv, write_csv
from minekit.sources.schemas import RATINGS


def recommend(
    spark: SparkSession,
    ratings_path: str,
    items_path: str,
    out_dir: str,
    user: int = 0,
    trials: Sequence[tuple[int, float]] = als.TRIALS,
    folds: int = 5,
) -> str:
    """80/20 split, search on the 80 %, errors and MAP on the 20 %, five titles for ``user``."""
    rated = checkpointed(
        read_csv(spark, ratings_path, RATINGS)
        .select(F.col("userId").alias("user"), F.col("movieId").alias("item"), "rating")
        .na.drop()
    )
    titles = typed_projection(
        read_csv(spark, items_path).select(F.col("movieId").alias("item"), "title"),
        {"item": "bigint", "title": "string"},
    )
    ratings, keys = als.int_ids(rated)
    train, test = hash_split(ratings, ["user", "item"], 0.8, seed="12345")
    found = als.als_search(train, trials, folds)
    scored = checkpointed(found.model.transform(test))
    errors = metrics.metrics_long(metrics.regression_metrics(scored, "rating").drop("mae"), "final")
    ranked = scored.withColumnRenamed("prediction", "score")
    precision = metrics.map_score(ranked, ranking.relevant_items(scored))
    report = errors.unionByName(metrics.metrics_long(precision, "final"))
    asked = rated.where(F.col("user") == user).select("user").distinct()
    picks = als.recommend(found.model, titles, asked, keys=keys).orderBy("rank").select("title")
    write_csv(picks, f"{out_dir}/recommendations", single_file=True)
    write_csv(found.trials, f"{out_dir}/foldPerformance", single_file=True)
    write_csv(report, f"{out_dir}/finalPerformance", single_file=True)
    return out_dir
