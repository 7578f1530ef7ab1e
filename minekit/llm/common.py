"""What the training-data operators share: written intermediates, let-bindings, the label split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minekit.operators.scale import scratch_path, ship_package


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and go on from the files.

    The files cut the lineage and outlive lost executors; what is random or numbered by
    partition in ``df`` is fixed from here on.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str | Column = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def unused(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df``, also those with dots in their names."""
    return [F.col("`{}`".format(c.replace("`", "``"))) for c in df.columns]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often ``body`` names it.

    Without it an expression used inside a lambda is evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def held_out(doc_id: str | Column) -> Column:
    """True for the third of the ids that no model may learn from; a missing id counts as held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 3 == 1, F.lit(True))


#: Rows that Spark hands to a Python worker at a time, instead of its default: whole texts are large.
BATCH_ROWS = 1000
_BATCH, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def importable(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, wherever they run; once a session.

    The session's batch size becomes ``BATCH_ROWS`` unless it has one of its own.
    """
    if spark.conf.get(_BATCH) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    ship_package(spark)
