"""Trips: classify the duration bin, route by predicted class, regress the duration per class."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from minekit.operators import metrics, models
from minekit.operators.prep import hash_split
from minekit.operators.scale import with_row_id
from minekit.sources import output_path, read_csv, write_csv, write_routed, write_text
from minekit.sources.schemas import SEGMENT, TRIP_FEATURES, TRIPS

SEGMENT_COLUMNS = [*TRIP_FEATURES, "trip_duration"]


def classify(
    spark: SparkSession, train_path: str, out_dir: str, grid: dict | None = None, folds: int | None = None
) -> str:
    """Search a decision tree, score all trips, one CSV folder per predicted class, and a report.

    The report has the accuracy on the training table and the cross-validated one.
    """
    trips = with_row_id(read_csv(spark, train_path, TRIPS).na.drop())
    found = models.fit_supervised(
        trips, "dt_class", TRIP_FEATURES, "duration_bin", ["row_id"], grid, folds
    )
    scored = models.score(found.model, trips)
    routed = scored.select(*SEGMENT_COLUMNS, "duration_bin", F.col("prediction").cast("int").alias("prediction"))
    write_routed(routed, f"{out_dir}/classes", fmt="csv")
    trained = metrics.accuracy(scored, "duration_bin").first()["accuracy"]
    held_out = found.trials.where("best").first()["mean_accuracy"]
    rows = [("dt_class", "accuracy_train", trained), ("dt_class", "accuracy_cv", held_out)]
    write_csv(metrics.metrics_table(spark, rows), f"{out_dir}/result", single_file=True)
    write_text(models.model_report(spark, "dt_class", found.model).select("text"), f"{out_dir}/tree")
    return f"{out_dir}/classes"


def regress(
    spark: SparkSession, segment_path: str, out_dir: str, grid: dict | None = None, folds: int | None = None
) -> str:
    """Linear regression of the trip duration on one class: 80/20 split, search, predictions, errors."""
    rows = with_row_id(read_csv(spark, segment_path, SEGMENT).na.drop())
    train, test = hash_split(rows, ["row_id"], 0.8, seed="12345")
    found = models.fit_supervised(
        train, "linear", TRIP_FEATURES, "trip_duration", ["row_id"], grid, folds
    )
    scored = models.score(found.model, test)
    out = output_path(out_dir, "regres-", segment_path)
    write_csv(scored.select(*SEGMENT_COLUMNS, "prediction"), out)
    errors = metrics.regression_metrics(scored, "trip_duration").select("rmse", "mae")
    name = segment_path.rstrip("/").rsplit("/", 1)[-1]
    write_csv(metrics.metrics_long(errors, name), f"{out_dir}/regress-result-{name}", single_file=True)
    return out
