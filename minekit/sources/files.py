"""CSV and text readers and writers.

Readers accept globs (``dir/*.csv``). Writers keep Spark's default save mode: an existing
output is an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str | None = None,
    header: bool = True,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with an explicit schema, or all strings. A schema shorter than the file reads its prefix.

    Column names come from the schema, by position; fields that do not parse become NULL. Free
    text with line breaks needs ``multi_line``; such files are read whole, one task per file.
    """
    reader = spark.read.option("header", header).option("mode", "PERMISSIVE")
    reader = reader.option("escape", '"').option("multiLine", multi_line)
    if schema is None:
        return reader.csv(path)
    return reader.schema(schema).csv(path)


def read_headerless(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV without header: string columns ``_c0, _c1, ...``."""
    return read_csv(spark, path, header=False)


def write_csv(
    df: DataFrame,
    path: str,
    header: bool = True,
    single_file: bool = False,
    partition_by: Sequence[str] | None = None,
) -> None:
    """Write CSV in parallel, in one execution of ``df``.

    ``single_file`` is for reports whose size their own parameters bound: the finished rows are moved
    into one file, and the upstream work stays parallel.
    """
    if single_file:
        df = df.repartition(1)
    writer = df.write.option("header", header).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_text(df: DataFrame, path: str, sep: str = ",") -> None:
    """One line per row, columns joined by ``sep``; NULL is written as an empty field."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).write.text(path)


def write_routed(df: DataFrame, path: str, by: str = "prediction", fmt: str = "parquet") -> None:
    """One output folder per value of ``by``, written by one job over one scoring pass."""
    writer = df.write.partitionBy(by)
    writer.option("header", True).format(fmt).save(path)


def read_routed(
    spark: SparkSession, path: str, value: object, by: str = "prediction", fmt: str = "parquet"
) -> DataFrame:
    """The rows routed to one value; only that folder is listed and read."""
    return spark.read.option("header", True).format(fmt).load(path).where(F.col(by) == F.lit(value))


def output_path(out_dir: str, prefix: str, input_path: str) -> str:
    """``<out_dir>/<prefix><input file name>``."""
    return f"{out_dir.rstrip('/')}/{prefix}{input_path.rstrip('/').rsplit('/', 1)[-1]}"
