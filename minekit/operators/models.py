"""Supervised models: pipelines, grid search over hash folds, scoring, routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool
from typing import NamedTuple

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators import moments
from minekit.operators.metrics import hit_rate, root_mean_square
from minekit.operators.prep import fold_test, fold_train, with_fold
from minekit.operators.scale import checkpoint_root, scratch_path, spread

_KINDS = {
    "dt_class": DecisionTreeClassifier,
    "linear": LinearRegression,
    "dt": DecisionTreeRegressor,
    "rf": RandomForestRegressor,
    "gbt": GBTRegressor,
}

# The hyper-parameter grids searched per model kind, and the fold counts.
GRIDS: dict[str, dict[str, list]] = {
    "dt_class": {"maxDepth": [2, 3, 4, 5, 6]},
    "linear": {"regParam": [1000.0, 0.001], "maxIter": [1, 10]},
    "dt": {"maxDepth": [5, 8, 10]},
    "rf": {"maxDepth": [5, 8, 10]},
    "gbt": {"maxIter": [3, 5, 7]},
}
FOLDS = {"dt_class": 10, "linear": 10, "dt": 5, "rf": 5, "gbt": 5}


DEAL = "_deal"  # beginning of the names of columns that decide in which part a row is
#: Rows that concurrent fits of a search hold in memory together, beyond which fewer of them run at a time.
ROWS_AT_ONCE = 40_000_000


class Search(NamedTuple):
    """Outcome of a grid search: the refitted best model and one row per (setting, fold)."""

    model: Model
    trials: DataFrame
    best: dict[str, object]


def build_pipeline(kind: str, features: Sequence[str], label: str, **params) -> Pipeline:
    """Assemble the feature columns, then the estimator of ``kind``; NULL features are an error."""
    assembler = VectorAssembler(
        inputCols=list(features), outputCol="features", handleInvalid="error"
    )
    if kind in ("dt_class", "dt", "rf", "gbt"):
        params.setdefault("seed", 12345)
    estimator = _KINDS[kind](featuresCol="features", labelCol=label, **params)
    return Pipeline(stages=[assembler, estimator])


def expand_grid(estimator: Estimator, grid: Mapping[str, Sequence]) -> list[dict[Param, object]]:
    """All combinations of the named parameter values."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return builder.build()


def dealt_by(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``columns`` of ``df`` and its keys once more, under names that no feature has."""
    return df.select(*columns, *[F.col(k).alias(f"{DEAL}{i}") for i, k in enumerate(keys)])


def nested_param(estimator: Estimator, features: Sequence[str]) -> str | None:
    """The parameter whose smaller values give a part of the model of its largest value, if there is one.

    A tree is grown level by level and a boosted model tree by tree, so a smaller ``maxDepth`` is the same tree cut
    off there and a smaller ``maxIter`` its first trees. Of a forest this holds as long as every node sees all
    features; otherwise the draws of a node depend on the nodes before it.
    """
    if isinstance(estimator, (DecisionTreeClassifier, DecisionTreeRegressor)):
        moved = estimator.hasParam("thresholds") and estimator.isSet("thresholds")
        return None if moved else "maxDepth"
    if isinstance(estimator, RandomForestRegressor):
        every = estimator.getFeatureSubsetStrategy() == "all" or len(features) == 1
        return "maxDepth" if every else None
    if isinstance(estimator, GBTRegressor):
        return None if estimator.isSet("validationIndicatorCol") else "maxIter"
    return None


def families(settings: Sequence[Mapping[Param, object]], param: str | None) -> list[list[int]]:
    """Positions of settings that differ in ``param`` alone, the largest value last; one each without ``param``."""
    if param is None or not all(any(p.name == param for p in s) for s in settings):
        return [[i] for i in range(len(settings))]
    value = [next(v for p, v in s.items() if p.name == param) for s in settings]
    alike: dict[tuple, list[int]] = {}
    for i, s in enumerate(settings):
        alike.setdefault(tuple(sorted((p.name, repr(v)) for p, v in s.items() if p.name != param)), []).append(i)
    return [sorted(group, key=lambda i: value[i]) for group in alike.values()]


def _paths(spark: SparkSession, stage: Model) -> list[list[list[float]]]:
    """Per tree and leaf, in the order in which the model numbers leaves: predictions from the root to the leaf."""
    path = scratch_path(spark, "trees")
    stage.write().save(path)
    rows = spark.read.parquet(f"{path}/data")
    if "treeID" in rows.columns:
        rows = rows.select("treeID", "nodeData.*")
    else:
        rows = rows.withColumn("treeID", F.lit(0))
    trees: dict[int, dict[int, tuple]] = {}
    # the model, bounded by its parameters
    for r in rows.select("treeID", "id", "prediction", "leftChild", "rightChild").collect():
        trees.setdefault(r["treeID"], {})[r["id"]] = (r["prediction"], r["leftChild"], r["rightChild"])
    out = []
    for _, nodes in sorted(trees.items()):
        leaves, waiting = [], [(0, [])]
        while waiting:
            node, above = waiting.pop()
            prediction, left, right = nodes[node]
            way = [*above, prediction]
            if left < 0:
                leaves.append(way)
            else:
                waiting += [(right, way), (left, way)]
        out.append(leaves)
    return out


def scored_nested(model: PipelineModel, df: DataFrame, param: str, values: Sequence[int]) -> tuple[DataFrame, list[str]]:
    """``df`` with the predictions of ``model`` had its ``param`` been each of ``values``, and their columns.

    Each row is scored once, by the leaves it falls into; what a smaller model says there is looked up.
    """
    spark, stage = df.sparkSession, model.stages[-1]
    stage.setLeafCol("_leaf")
    scored = model.transform(df)
    if "vector" in dict(scored.dtypes)["_leaf"]:
        leaves = vector_to_array(F.col("_leaf"))
    else:
        leaves = F.array("_leaf")
    found = scored.withColumn("_leaves", leaves)
    paths = _paths(spark, stage)

    def said(tree: int, of) -> Column:
        numbers = ", ".join(f"{float(of(way))!r}D" for way in paths[tree])
        return F.expr(f"array({numbers})[int(_leaves[{tree}])]")

    def sum_of(terms: list[Column]) -> Column:
        out = terms[0]
        for term in terms[1:]:
            out = out + term
        return out

    names = [f"_prediction{i}" for i in range(len(values))]
    for name, value in zip(names, values):
        if param == "maxIter":
            weights = stage.treeWeights
            column = sum_of([said(t, lambda way: way[-1]) * F.lit(float(weights[t])) for t in range(min(value, len(paths)))])
        else:
            column = sum_of([said(t, lambda way: way[min(value, len(way) - 1)]) for t in range(len(paths))]) / len(paths)
        found = found.withColumn(name, column)
    return found, names


def _plain_least_squares(estimator: Estimator, settings: Sequence[Mapping[Param, object]]) -> bool:
    """Whether every setting is least squares with a squared penalty at most, which ``pyspark.ml`` solves directly."""
    if not isinstance(estimator, LinearRegression):
        return False
    free = {"featuresCol", "labelCol", "predictionCol", "regParam", "maxIter"}
    usual = LinearRegression().extractParamMap()
    expected = {p.name: v for p, v in usual.items()}
    own = {p.name: v for p, v in estimator.extractParamMap().items()}
    searched = {p.name for s in settings for p in s}
    return searched <= {"regParam", "maxIter"} and all(
        own.get(name) == expected.get(name) for name in {*own, *expected} - free
    )


def _least_squares_trials(
    data: DataFrame, features: Sequence[str], label: str, regs: Sequence[float], folds: int
) -> list[tuple[int, int, float | None]] | None:
    """``(setting, fold, rmse)`` of all penalties and folds from the moments of the folds, read once.

    None where a penalty of zero meets columns that explain each other, as the answer is not unique then, or where
    a fold holds all rows. A fold without rows has no error.
    """
    # the features are an error if they are missing, and the refit on all rows says so
    grouped = moments.gathered(data.withColumn("_all", F.lit(0)), "_all", features, label)
    parts = {r["fold"]: moments.of_row(r, len(features) + 1) for r in grouped.collect()}
    if len(parts) < 2:
        return None
    out: list[tuple[int, int, float | None]] = []
    for fold in range(folds):
        rest = moments.total([m for f, m in sorted(parts.items()) if f != fold])
        if min(regs) <= 0.0 and not moments.independent(rest):
            return None
        for i, reg in enumerate(regs):
            out.append((i, fold, moments.rmse(parts[fold], *moments.fit(rest, reg)) if fold in parts else None))
    return out


def search_settings(
    data: DataFrame,
    estimator: Estimator,
    settings: Sequence[Mapping[Param, object]],
    label: str,
    metric: str,
    folds: int,
    parallelism: int = 4,
    tidy: bool = False,
    features: Sequence[str] | None = None,
    measured: Callable[[DataFrame], list[tuple[int, int, float | None]]] | None = None,
) -> Search:
    """Every setting on every fold of ``data``, mean metric, refit.

    ``data`` has a ``fold`` column and columns ``_deal...`` that identify a row. The input is
    persisted once, dealt by them, and each fold is a filter on it. Settings whose models are parts of one
    another are one fit per fold and are scored in one pass, and least squares needs the moments of the
    folds only; for both ``features`` are to be given, numeric columns that a pipeline assembles.
    Fits run concurrently so that small stages of one fit do not leave the cluster idle, fewer of them where
    their copies of the input would not fit into memory together. The earlier setting wins ties. With ``tidy``
    the shuffle files of a fit go when it is scored, for estimators that shuffle much more than their input.
    ``measured`` gives ``(setting, fold, metric)`` of the kept input where there is a way without a fit for each.
    """
    spark = data.sparkSession
    checkpoint_root(spark)
    larger_is_better = metric == "accuracy"
    last = estimator.getStages()[-1] if isinstance(estimator, Pipeline) else estimator
    param = nested_param(last, features) if features is not None else None
    groups = families(settings, param)
    data = spread(data, [c for c in data.columns if c.startswith(DEAL)])
    try:
        measure = hit_rate if larger_is_better else root_mean_square

        @inheritable_thread_target(spark)
        def run(task: tuple[list[int], int]) -> list[tuple[int, int, float]]:
            group, fold = task
            model = estimator.fit(fold_train(data, fold), dict(settings[group[-1]]))
            if len(group) == 1:
                scored, names = model.transform(fold_test(data, fold)), ["prediction"]
            else:
                values = [next(v for p, v in settings[i].items() if p.name == param) for i in group]
                scored, names = scored_nested(model, fold_test(data, fold), param, values)
            found = scored.agg(*[measure(label, name).alias(name) for name in names]).first()
            results = [(i, fold, value) for i, value in zip(group, found)]
            del model, scored
            if tidy:
                # Spark deletes the shuffle files of a fit once the driver's collector finds that nobody holds it
                spark.sparkContext._jvm.System.gc()
            return results

        results = measured(data) if measured is not None else None
        if results is None and features is not None and not larger_is_better and _plain_least_squares(last, settings):
            regs = [float({p.name: v for p, v in s.items()}.get("regParam", last.getRegParam())) for s in settings]
            results = _least_squares_trials(data, features, label, regs, folds)
        if results is None:
            tasks = [(group, fold) for fold in range(folds) for group in groups]
            at_once = min(parallelism, len(tasks))
            if features is not None:
                at_once = min(at_once, ROWS_AT_ONCE // max(data.count(), 1))
            with ThreadPool(max(1, at_once)) as pool:
                results = [r for found in pool.map(run, tasks, chunksize=1) for r in found]
        results = sorted(results, key=lambda r: r[:2])
        means = []
        for i in range(len(settings)):
            # an empty test fold has no metric
            values = [v for j, _, v in results if j == i and v is not None]
            means.append(sum(values) / len(values) if values else None)
        sign = -1.0 if larger_is_better else 1.0
        scored_settings = [(sign * m, i) for i, m in enumerate(means) if m is not None]
        if not scored_settings:
            raise ValueError("no fold could be evaluated")
        best = min(scored_settings)[1]
        model = estimator.fit(data, dict(settings[best]))
    finally:
        data.unpersist()
    named = [{p.name: v for p, v in s.items()} for s in settings]
    rows = [
        (i, ", ".join(f"{k}={v}" for k, v in sorted(named[i].items())), fold, value, means[i], i == best)
        for i, fold, value in results
    ]
    trials = spark.createDataFrame(
        rows, f"trial int, setting string, fold int, {metric} double, mean_{metric} double, best boolean"
    )
    return Search(model, trials, named[best])


def fit_supervised(
    train: DataFrame,
    kind: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    grid: Mapping[str, Sequence] | None = None,
    folds: int | None = None,
    parallelism: int = 4,
    **params,
) -> Search:
    """Grid search of one model kind; ``keys`` identify a row and decide its fold.

    Only the needed columns are kept, so the persisted input is as narrow as the model.
    """
    pipeline = build_pipeline(kind, features, label, **params)
    settings = expand_grid(pipeline.getStages()[-1], grid if grid is not None else GRIDS[kind])
    k = folds or FOLDS[kind]
    columns = list(dict.fromkeys([*features, label]))
    data = dealt_by(with_fold(train, keys, k), keys, [*columns, "fold"])
    metric = "accuracy" if kind == "dt_class" else "rmse"
    return search_settings(data, pipeline, settings, label, metric, k, parallelism, features=features)


def fit_all(train: DataFrame, kind: str, features: Sequence[str], label: str, **params) -> PipelineModel:
    """Fit on all rows without a search."""
    checkpoint_root(train.sparkSession)
    return build_pipeline(kind, features, label, **params).fit(train)


def score(model: Model, df: DataFrame) -> DataFrame:
    """Batch scoring: the input plus ``prediction``."""
    return model.transform(df).drop("features", "rawPrediction", "probability")


def wide_prediction(scored: DataFrame, id_col: str, id_name: str, names: Sequence[str]) -> DataFrame:
    """One id column and the same prediction under each of ``names``."""
    return scored.select(id_col, *[F.col("prediction")] * len(names)).toDF(id_name, *names)


def tree_text(model: Model) -> str:
    """Text form of the last stage: the learned tree(s), or the coefficients."""
    stage = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(stage, "toDebugString"):
        return stage.toDebugString
    return f"coefficients={list(stage.coefficients)} intercept={stage.intercept}"


def model_report(spark: SparkSession, name: str, model: Model) -> DataFrame:
    """``(model, text)``: one row with the model's text form."""
    return spark.createDataFrame([(name, tree_text(model))], "model string, text string")


def segment_regression(df: DataFrame, segment: str, x: str, y: str) -> DataFrame:
    """One simple least-squares line per segment, all segments in one aggregate."""
    return df.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
    )


def fit_per_segment(
    df: DataFrame,
    segment: str,
    segments: Sequence[object],
    kind: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    **options,
) -> dict[object, Search]:
    """One searched model per listed segment value (a handful of predicted classes)."""
    return {
        s: fit_supervised(
            df.where(F.col(segment) == F.lit(s)), kind, features, label, keys, **options
        )
        for s in segments
    }
