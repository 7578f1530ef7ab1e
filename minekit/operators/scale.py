"""Building blocks that keep the operators safe on large, skewed inputs."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Sequence
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import minekit

_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of this session import the package, wherever they run; once a session.

    Spark hands the archive to every executor, also to those that start later.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(minekit.__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="minekit-code-")) / "minekit.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A session names it in ``spark.checkpoint.dir``; without the setting a folder in the warehouse
    serves, which all executors reach as well. Which of them does not depend on the master.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{warehouse}/_checkpoints")
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from the written copy."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` in ``spark.sql.shuffle.partitions`` parts by a hash of ``keys``, sorted within them.

    For inputs of iterative fits, which depend on the placement of rows. Neither the number of cores
    nor the layout of the input files has a say in it, at any size; ``keys`` identify a row, so no
    part gets hot.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys).sortWithinPartitions(*keys)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Add a unique id to rows without a key; the checkpoint keeps it fixed for good."""
    return checkpointed(df.withColumn(name, F.monotonically_increasing_id()))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def large_groups(df: DataFrame, key: str, max_rows: int) -> DataFrame:
    """``(key, size)`` of the groups above ``max_rows`` rows, pre-aggregated before the shuffle."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > max_rows)


def in_parts(
    df: DataFrame, key: str, value: str, max_rows: int, large: DataFrame | None = None
) -> DataFrame:
    """Split groups of ``key`` larger than ``max_rows`` by a hash of ``value``.

    Adds ``parts`` (how many parts the row's group has, 1 for ordinary groups) and ``part``
    (0..parts-1). Only the sizes of the large groups (``large_groups``, unless given) are joined
    back, so the side AQE may broadcast is measured at run time; when it is too large the
    sort-merge join splits a hot key of the left side.
    """
    if large is None:
        large = large_groups(df, key, max_rows)
    sizes = large.select(key, F.ceil(F.col("size") / F.lit(max_rows)).cast("bigint").alias("_parts"))
    part = F.pmod(F.xxhash64(F.col(value).cast("string")), F.col("_parts"))
    return (
        df.join(sizes, key, "left")
        .withColumn("parts", F.coalesce("_parts", F.lit(1).cast("bigint")))
        .withColumn("part", F.when(F.col("_parts").isNull(), F.lit(0).cast("bigint")).otherwise(part))
        .drop("_parts")
    )


def list_parts(df: DataFrame, key: str, value: str, max_rows: int, entry: Column) -> DataFrame:
    """``(key, part, entries)``: the ``entry`` of each row as a sorted list per part of its group.

    Rows are dealt by (key, part) explicitly. Left to itself the aggregate would reuse the
    placement by ``key`` from ``in_parts`` and put all parts of a hot key into one task.
    """
    return (
        in_parts(df, key, value, max_rows)
        .repartition(key, "part")
        .groupBy(key, "part")
        .agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    )


def spread(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Persist a table that many passes will read, dealt by ``keys``, which are not kept.

    Without ``keys`` rows are dealt by all columns, which are kept; equal rows then share a part.
    """
    rest = [c for c in df.columns if c not in keys]
    kept = dealt(df, keys or df.columns).select(*rest).persist(StorageLevel.MEMORY_AND_DISK)
    kept.count()
    return kept


def number_rows(df: DataFrame, order: list[Column | str], name: str = "idx") -> DataFrame:
    """Consecutive numbers 0, 1, 2, ... following ``order``, without a one-task sort.

    Rows are range-partitioned and sorted in parallel; each row gets the number of rows in the
    earlier partitions plus its own position. The checkpoint pins rows to partitions, so the
    partition sizes and the positions come from one and the same placement even if executors
    are lost in between. ``order`` must be total for reproducible numbers.
    """
    placed = checkpointed(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
    ).withColumn("_slice", F.shiftright("_at", _ROW_BITS))
    # one row per partition bounds the window and the broadcast
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_slice")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    )
    position = F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_slice")
        .withColumn(name, F.col("_before") + position)
        .drop("_slice", "_at", "_before")
    )
