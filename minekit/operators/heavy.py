"""Most frequent values by a mergeable summary and one exact pass over its candidates.

The summary keeps a bounded number of counters per column and task (Misra-Gries counters, as Spark's
``approx_top_k`` has them), and summaries merge, so distinct values are not shuffled. It names the candidates;
these alone are counted exactly. A value that it leaves out occurs at most ``_LEFT_OUT / tracked`` of the rows, so
counts above that prove the ranking. Columns where this proves nothing are counted in full.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minekit.operators.prep import value_frequency

#: Counters per column.
TRACKED = 4096
#: The summary's counts are off by at most 3.5 rows in ``tracked``, and it names what is surely above its error.
_LEFT_OUT = 7.0


def _cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def candidates(df: DataFrame, cols: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """``(column, value)``: NULL and at most ``tracked`` values of each column, in one pass."""
    shown = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(cols)])
    tops = [
        F.expr(f"transform(approx_top_k(c{i}, {tracked}, {tracked}), x -> x.item)").alias(f"c{i}")
        for i in range(len(cols))
    ]
    named = [F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("values")) for i, c in enumerate(cols)]
    found = shown.agg(*tops).select(F.inline(F.array(*named)))
    null = F.array(F.lit(None).cast("string"))
    every = F.array_distinct(F.concat(F.coalesce("values", F.array().cast("array<string>")), null))
    return found.select("column", F.explode(every).alias("value"))


def counted(df: DataFrame, cols: Sequence[str], tracked: int = TRACKED) -> DataFrame:
    """``(column, value, n)``: the exact counts of the candidates."""
    # bounded by columns x (tracked + 1) rows
    few = F.broadcast(candidates(df, cols, tracked))
    cells = _cells(df, cols).alias("x")
    same = [F.col("x.column") == F.col("y.column"), F.col("x.value").eqNullSafe(F.col("y.value"))]
    return (
        cells.join(few.alias("y"), same, "left_semi")
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heavy_hitters(df: DataFrame, cols: Sequence[str], k: int = 5, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``prep.value_frequency``: the ``k`` most frequent values, NULL included, ties by value.

    A column is proven if its k-th count is above what the summary may leave out, or if the candidates
    are all its values; only the names of the others come to the driver.
    """
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc_nulls_first("value"))
    counts = counted(df, cols, tracked)
    rows = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    ranked = counts.withColumn("rank", F.row_number().over(order).cast("bigint"))
    facts = ranked.groupBy("column").agg(
        F.sum("n").alias("covered"), F.max(F.when(F.col("rank") == k, F.col("n"))).alias("kth")
    )
    sure = (F.col("covered") == rows) | (F.coalesce("kth", F.lit(0)) > rows * _LEFT_OUT / tracked)
    proven = {r["column"] for r in facts.where(sure).select("column").collect()}
    open_ = [c for c in cols if c not in proven]
    top = ranked.where((F.col("rank") <= k) & F.col("column").isin(sorted(proven)))
    return top.unionByName(value_frequency(df, open_, k)) if open_ else top
