"""Building blocks that keep ranks, lags and joins spread over many tasks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16  # consecutive order values in one window group
_PLACE_BITS = 33  # rows of one partition, as in monotonically_increasing_id
_OWNED: set[str] = set()
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def durable_dir(spark: SparkSession) -> str:
    """The run's own folder for written intermediate tables.

    Clusters name the shared parent in ``spark.checkpoint.dir``.  A parent of
    our own is made only on a local master where none is named.  Each
    application owns one subfolder, which goes when the application ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="tmloom-")
        spark.conf.set("spark.checkpoint.dir", named)
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    folder = f"{named.rstrip('/')}/tmloom-{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _OWNED.add(folder)
    return folder


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once to the run's folder and read it back.

    Used where a second evaluation would cost a model call or could differ.
    ``release`` drops the table before the application ends.
    """
    spark = df.sparkSession
    path = f"{durable_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_at = path
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` returned and nothing reads any more: those of the round before last, say."""
    for table in tables:
        at = getattr(table, "_written_at", None)
        if at is not None:
            spark = table.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def joined_in_place(spark: SparkSession) -> Iterator[None]:
    """Joins that run inside leave tables where they are that are dealt by some of the join's keys, not by all."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)


def global_rank(
    df: DataFrame, id_col: str, out: str = "rank", ties: Sequence[str] = ()
) -> DataFrame:
    """Add the 0-based position of each row in ``id_col`` order, without a
    one-partition window over rows.

    Rows are range-partitioned, sorted and written once with their place in
    their partition; only the number of rows of each partition, one row per
    partition, passes through a single task.  So sparse ids, hashes say, cost no
    more than dense ones.
    """
    order = [id_col, *ties]
    return numbered_in_place(df.repartitionByRange(*order).sortWithinPartitions(*order), out)


def numbered_in_place(df: DataFrame, out: str = "rank") -> DataFrame:
    """Add the 0-based position of each row of ``df``, whose rows are in order already; they are not moved again."""
    placed = materialize(df.withColumn("_place", F.monotonically_increasing_id()), "ranked").withColumn(
        "_part", F.shiftright("_place", _PLACE_BITS)
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .count()
        .select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    )
    inside = F.col("_place").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_offset") + inside)
        .drop("_part", "_place", "_offset")
    )


def previous_value(
    df: DataFrame,
    keys: Sequence[str],
    order_col: str,
    value: Column,
    out: str,
    chunk_bits: int = CHUNK_BITS,
) -> DataFrame:
    """Add the value of the preceding row of the same key in ``order_col`` order.

    A plain lag would sort a whole key in one task.  Here rows of a key are cut
    into chunks of consecutive order values; only the first row of a chunk asks
    for the last value of an earlier chunk, which is combined before shuffling.
    """
    parts = [*keys, "_chunk"]
    rows = df.withColumn(
        "_chunk", F.shiftright(F.col(order_col).cast("long"), chunk_bits)
    ).withColumn("_value", value)
    lasts = rows.groupBy(*parts).agg(F.max_by("_value", order_col).alias("_last"))
    carried = lasts.select(
        *parts,
        F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_carried"),
    )
    window = Window.partitionBy(*parts).orderBy(order_col)
    return (
        rows.withColumn("_first", F.row_number().over(window) == 1)
        .withColumn("_lag", F.lag("_value").over(window))
        .join(carried, parts)
        .withColumn(out, F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("_lag")))
        .drop("_chunk", "_value", "_first", "_lag", "_carried")
    )
