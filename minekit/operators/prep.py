"""Tabular preparation: profiles, imputation, casts, splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minekit.functions import bucket_of, hash32, number_from_text, whole_number


def _long_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for all columns from one scan and one aggregate."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    return (
        df.select(F.explode(cells).alias("c"))
        .groupBy("c.column", "c.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def value_frequency(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values (NULL included) of each column: ``(column, value, n, rank)``."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    return (
        _long_counts(df, cols)
        .withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
    )


def column_modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent non-null value per column, ties to the smallest: ``(column, value, n)``.

    Of numbers the smallest is meant as a number, so 9 comes before 10.
    """
    numeric = [c for c in cols if isinstance(df.schema[c].dataType, T.NumericType)]
    # decimal, not double: longs that a double cannot tell apart stay apart
    kind = "double" if any(isinstance(df.schema[c].dataType, T.FractionalType) for c in numeric) else "decimal(38,0)"
    number = F.when(F.col("column").isin(numeric), F.col("value")).try_cast(kind)
    best = F.min(F.struct((-F.col("n")).alias("neg"), number.alias("number"), "value"))
    return (
        _long_counts(df, cols)
        .where(F.col("value").isNotNull())
        .groupBy("column")
        .agg(best.alias("m"))
        .select("column", "m.value", (-F.col("m.neg")).alias("n"))
    )


def impute_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace NULLs by one constant per column, converted to the column's own type."""
    typed = {f.name: f.dataType for f in df.schema.fields}
    filled = {
        c: F.coalesce(F.col(c), F.lit(_constant(v, typed[c])).cast(typed[c]))
        for c, v in values.items()
    }
    return df.withColumns(filled)


def _constant(value: object, to: T.DataType) -> object:
    """A text constant read as the column's kind of number (``"2.0"`` -> 2 for an int column)."""
    if isinstance(value, str) and isinstance(to, T.IntegralType):
        return int(Decimal(value))
    if isinstance(value, str) and isinstance(to, T.FractionalType):
        return float(value)
    return value


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace NULLs by the column's most frequent value.

    The modes reach the rows as one scalar subquery (a single struct), so the operator stays one
    lazy plan and nothing passes through the driver.
    """
    picks = [
        F.max(F.when(F.col("column") == c, F.col("value"))).alias(f"m{i}")
        for i, c in enumerate(cols)
    ]
    modes = (
        column_modes(df, cols)
        .agg(*picks)
        .select(F.struct(*[f"m{i}" for i in range(len(cols))]).alias("modes"))
        .scalar()
    )
    typed = {f.name: f.dataType for f in df.schema.fields}
    filled = {
        c: F.coalesce(F.col(c), modes[f"m{i}"].try_cast(typed[c])) for i, c in enumerate(cols)
    }
    return df.withColumns(filled)


def typed_projection(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Select and convert text columns; unreadable text becomes NULL, never an error."""
    return df.select(*[_typed(c, t).alias(c) for c, t in types.items()])


def _typed(c: str, to: str) -> Column:
    if to in ("int", "integer", "bigint", "long"):
        return whole_number(c, {"integer": "int", "long": "bigint"}.get(to, to))
    if to in ("double", "float"):
        return number_from_text(c, to)
    return F.col(c).try_cast(to)


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: rows, non-null and null counts, mean, sample stddev, min, max. One pass."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    rows = F.count(F.lit(1))
    entries = []
    for c in cols:
        filled = F.count(F.col(c))
        number = F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                filled.alias("n"),
                (rows - filled).alias("n_null"),
                F.avg(number).alias("mean"),
                F.stddev_samp(number).alias("stddev"),
                F.min(number).alias("min"),
                F.max(number).alias("max"),
            )
        )
    return df.agg(F.array(*entries).alias("p")).select(F.explode("p").alias("c")).select("c.*")


def drop_nulls(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without any NULL."""
    return df.na.drop(subset=list(cols) if cols else None)


def drop_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Row counts before and after ``drop_nulls``, from one scan."""
    complete = F.lit(True)
    for c in cols or df.columns:
        complete = complete & F.col(c).isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(complete, 1)).alias("rows_after"),
    )


def feature_table(
    left: DataFrame, right: DataFrame, key: str, cols: Sequence[str], names: Sequence[str] | None = None
) -> DataFrame:
    """Inner join on ``key``, keep ``cols`` in order, optionally rename them by position."""
    out = left.join(right, key).select(*cols)
    return out.toDF(*names) if names else out


def hash_split(
    df: DataFrame, keys: Sequence[str], frac: float = 0.8, seed: str = ""
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts, about ``frac`` and ``1 - frac``, decided per row key.

    Unlike a random split the decision is a function of the key, so recomputed partitions and
    both halves always agree.
    """
    below = hash32(*keys, seed=seed) < F.lit(int(frac * 2**32))
    return df.where(below), df.where(~below)


def with_fold(df: DataFrame, keys: Sequence[str], k: int = 5, seed: str = "") -> DataFrame:
    """Add ``fold`` in 0..k-1, decided per row key."""
    return df.withColumn("fold", bucket_of(*keys, buckets=k, seed=seed).cast("int"))


def fold_train(df: DataFrame, i: int) -> DataFrame:
    """All folds but ``i``; the union of the other folds without scanning the input k-1 times."""
    return df.where(F.col("fold") != i)


def fold_test(df: DataFrame, i: int) -> DataFrame:
    """Fold ``i``."""
    return df.where(F.col("fold") == i)


def fold_sizes(df: DataFrame) -> DataFrame:
    """``(fold, n_test, n_train)`` of a frame with a ``fold`` column."""
    sizes = df.groupBy("fold").agg(F.count(F.lit(1)).alias("n_test"))
    total = df.agg(F.count(F.lit(1))).scalar()
    return sizes.withColumn("n_train", total - F.col("n_test"))
