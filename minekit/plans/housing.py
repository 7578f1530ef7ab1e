"""Housing: prepare the feature tables, search tree models, score all parcels."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from minekit.operators import metrics, models, prep
from minekit.sources import read_csv, write_csv, write_text
from minekit.sources.schemas import (
    HOUSING_FEATURES,
    HOUSING_FILLS,
    HOUSING_LABEL,
    HOUSING_TYPES,
    LABELS,
    SCORING,
    TRAINING,
)

# The six months of the wide output.
MONTHS = ["201610", "201611", "201612", "201710", "201711", "201712"]


def prepare(
    spark: SparkSession, properties_path: str, labels_path: str, out_dir: str, impute: str = "constant"
) -> str:
    """Fill missing cells, convert types, join the labels; writes all parcels, the joined table, a profile.

    ``impute="mode"`` fills with the most frequent value found instead of the fixed constants.
    """
    raw = read_csv(spark, properties_path).select(*HOUSING_TYPES)
    if impute == "mode":
        filled = prep.impute_mode(raw, list(HOUSING_FILLS))
    else:
        filled = prep.impute_constant(raw, HOUSING_FILLS)
    typed = prep.typed_projection(filled, HOUSING_TYPES)
    labels = read_csv(spark, labels_path, LABELS).select("parcelid", HOUSING_LABEL)
    joined = prep.feature_table(typed, labels, "parcelid", [*HOUSING_TYPES, HOUSING_LABEL])
    write_csv(typed, f"{out_dir}/final_all")
    write_csv(joined, f"{out_dir}/final_joined")
    profile = prep.null_profile(typed, list(HOUSING_TYPES))
    write_csv(profile, f"{out_dir}/profile", single_file=True)
    return out_dir


def regress(
    spark: SparkSession, kind: str, train_path: str, out_dir: str, grid: dict | None = None, folds: int | None = None
) -> str:
    """Search a ``dt``, ``rf`` or ``gbt`` model on 70 %, report its error on the other 30 %."""
    raw = read_csv(spark, train_path, TRAINING)
    dropped = prep.drop_report(raw).first()
    train, test = prep.hash_split(prep.drop_nulls(raw), ["id_parcel"], 0.7)
    found = models.fit_supervised(train, kind, HOUSING_FEATURES, HOUSING_LABEL, ["id_parcel"], grid, folds)
    rmse = metrics.regression_metrics(models.score(found.model, test), HOUSING_LABEL).first()["rmse"]
    report = [
        (kind, "rows_before", dropped["rows_before"]),
        (kind, "rows_after", dropped["rows_after"]),
        (kind, "rmse", rmse),
    ]
    write_csv(metrics.metrics_table(spark, report), f"{out_dir}/{kind}-result", single_file=True)
    write_csv(found.trials, f"{out_dir}/{kind}-trials", single_file=True)
    write_text(models.model_report(spark, kind, found.model).select("text"), f"{out_dir}/{kind}-model")
    return out_dir


def predict(spark: SparkSession, train_path: str, scoring_path: str, out: str, **params) -> str:
    """Fit a random forest on all training rows and write six equal month columns per parcel."""
    train = prep.drop_nulls(read_csv(spark, train_path, TRAINING))
    parcels = prep.drop_nulls(read_csv(spark, scoring_path, SCORING))
    model = models.fit_all(train, "rf", HOUSING_FEATURES, HOUSING_LABEL, **params)
    scored = models.score(model, parcels).select("id_parcel", F.col("prediction"))
    write_csv(models.wide_prediction(scored, "id_parcel", "ParcelId", MONTHS), out)
    return out
