"""Linear regressions of all groups, folds and settings from one scan.

Counts, means and co-moments of features and label per (group, fold) are all that least squares needs. What a fold
trains on is the sum of the other folds' moments, and its error follows from its own, so no setting and no fold
reads the table again. Moments are combined about their means, which keeps them exact for large values.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from minekit.operators.prep import with_fold

#: Groups whose moments come to the driver at most, a few hundred numbers each.
MAX_GROUPS = 10_000


@dataclass(frozen=True)
class Moments:
    """Of the features, and of the label behind them."""

    n: int
    mean: np.ndarray
    co: np.ndarray  # sums of products of deviations

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        apart = other.mean - self.mean
        return Moments(
            n,
            self.mean + apart * other.n / n,
            self.co + other.co + np.outer(apart, apart) * self.n * other.n / n,
        )


def total(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for part in parts[1:]:
        out = out + part
    return out


def fit(m: Moments, reg: float = 0.0, alpha: float = 0.0, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """``(coefficients, intercept)`` with elastic-net penalty ``reg`` on standardised columns.

    The penalty is scaled by the label's deviation, as ``pyspark.ml`` does. ``alpha`` is the share of the absolute
    penalty. Constant columns have coefficient zero; of columns that explain each other the shortest solution is taken.
    """
    deviation = np.sqrt(np.diag(m.co) / m.n)
    # means carry rounding errors, so a constant column may show a trace of deviation
    deviation[deviation <= 1e-11 * np.abs(m.mean)] = 0.0
    x, y = deviation[:-1], deviation[-1]
    if y == 0.0 or not (x > 0).any():
        return np.zeros(len(x)), float(m.mean[-1])
    scale = np.where(x > 0, x, np.inf)
    g = m.co[:-1, :-1] / m.n / np.outer(scale, scale)
    c = m.co[:-1, -1] / m.n / scale / y
    penalty = reg / y
    if penalty * alpha == 0.0:
        b = np.linalg.lstsq(g + penalty * np.eye(len(c)), c, rcond=1e-12)[0]
    else:
        b = np.zeros(len(c))
        for _ in range(rounds):
            before = b.copy()
            for i in np.flatnonzero(x > 0):
                rest = c[i] - g[i] @ b + g[i, i] * b[i]
                b[i] = np.sign(rest) * max(abs(rest) - penalty * alpha, 0.0) / (g[i, i] + penalty * (1 - alpha))
            if np.abs(b - before).max() < 1e-12:
                break
    found = b * y / scale
    return found, float(m.mean[-1] - found @ m.mean[:-1])


def independent(m: Moments) -> bool:
    """Whether no column is constant or explained by the others."""
    deviation = np.sqrt(np.diag(m.co)[:-1] / m.n)
    if (deviation <= 1e-11 * np.abs(m.mean[:-1])).any():
        return False
    return bool(np.linalg.eigvalsh(m.co[:-1, :-1] / m.n / np.outer(deviation, deviation))[0] > 1e-9)


def of_row(r: Row, size: int) -> Moments:
    """The moments in a row of ``gathered`` over ``size`` columns."""
    co = np.zeros((size, size))
    co[np.triu_indices(size)] = r["covariance"]
    return Moments(r["n"], np.array(r["mean"]), (co + co.T - np.diag(np.diag(co))) * r["n"])


def rmse(m: Moments, coefficients: np.ndarray, intercept: float) -> float:
    """The root mean square error over the rows of these moments."""
    w = np.r_[-coefficients, 1.0]
    mean = w @ m.mean - intercept
    return math.sqrt(max(w @ m.co @ w / m.n + mean * mean, 0.0))


def gathered(df: DataFrame, group: str, features: Sequence[str], label: str) -> DataFrame:
    """One row per (group, fold): ``n``, the means and the upper half of the population covariances.

    Rows with a NULL or NaN in a feature or the label take no part.
    """
    names = [*features, label]
    values = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(names)]
    rows = df.select(F.col(group).alias("group"), "fold", *values).na.drop(subset=[f"v{i}" for i in range(len(names))])
    pairs = [F.covar_pop(f"v{i}", f"v{j}") for i in range(len(names)) for j in range(i, len(names))]
    return rows.groupBy("group", "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(f"v{i}") for i in range(len(names))]).alias("mean"),
        F.array(*pairs).alias("covariance"),
    )


def search(
    df: DataFrame,
    group: str,
    features: Sequence[str],
    label: str,
    keys: Sequence[str],
    settings: Sequence[tuple[float, float]],
    folds: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """Cross-validate every setting ``(reg, alpha)`` for every group; all from one aggregate.

    Gives the trials, ``(group, reg, alpha, fold, rmse, mean_rmse, best)``, and the models of the best settings on all
    rows of their group, ``(group, term, coefficient, reg, alpha)`` with a term ``intercept``. Folds are decided by
    the row keys; a fold that is the only one of its group has no error. The earlier setting wins ties.
    """
    spark = df.sparkSession
    found = gathered(with_fold(df, keys, folds), group, features, label)
    kind = df.schema[group].dataType.simpleString()
    groups: dict[object, dict[int, Moments]] = {}
    for r in found.limit(MAX_GROUPS * folds + 1).collect():
        groups.setdefault(r["group"], {})[r["fold"]] = of_row(r, len(features) + 1)
    if len(groups) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} groups")
    trials, models = [], []
    for name, parts in groups.items():
        errors: list[list[tuple[int, float | None]]] = []
        for reg, alpha in settings:
            row: list[tuple[int, float | None]] = []
            for fold in sorted(parts):
                others = [m for f, m in parts.items() if f != fold]
                row.append((fold, rmse(parts[fold], *fit(total(others), reg, alpha)) if others else None))
            errors.append(row)
        means = [sum(e for _, e in row) / len(row) if row[0][1] is not None else math.inf for row in errors]
        best = min(range(len(settings)), key=lambda i: (means[i], i))
        for i, ((reg, alpha), row) in enumerate(zip(settings, errors)):
            mean = None if math.isinf(means[i]) else means[i]
            trials += [(name, float(reg), float(alpha), fold, e, mean, i == best) for fold, e in row]
        reg, alpha = map(float, settings[best])
        coefficients, intercept = fit(total(list(parts.values())), reg, alpha)
        terms = [*zip(features, map(float, coefficients)), ("intercept", intercept)]
        models += [(name, term, value, reg, alpha) for term, value in terms]
    return (
        spark.createDataFrame(
            trials, f"group {kind}, reg double, alpha double, fold int, rmse double, mean_rmse double, best boolean"
        ),
        spark.createDataFrame(models, f"group {kind}, term string, coefficient double, reg double, alpha double"),
    )


def scored(df: DataFrame, group: str, models: DataFrame, features: Sequence[str], name: str = "prediction") -> DataFrame:
    """``df`` with the prediction of its group's model, NULL where the group has none."""
    # bounded by MAX_GROUPS rows
    wide = models.groupBy(F.col("group").alias("_group")).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "coefficient"))).alias("_model")
    )
    value = F.col("_model")["intercept"]
    for f in features:
        value = value + F.col(f"`{f}`") * F.col("_model")[f]
    return df.join(F.broadcast(wide), F.col(group) == F.col("_group"), "left").withColumn(name, value).drop(
        "_group", "_model"
    )
