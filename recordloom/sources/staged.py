"""Written tables that cut lineage, in the folder that all machines of the cluster share (``spark.checkpoint.dir``).

A table that is read back has known sizes, so joins with small ones are broadcast, and a lost executor costs a re-read.
Only where the setting is unset, and only in local mode, a temporary folder is used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[str] = []
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    global _local
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local = _local or tempfile.mkdtemp(prefix="recordloom-core-")
    return f"file://{_local}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when this process ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = new_path(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "rn", within: Sequence[str] = (), total: str | None = None) -> DataFrame:
    """``df`` with the row's number (from 1) in a total order, within each value of ``within``, and with the number of the
    value's rows as ``total`` if that is named; with no task for all rows of one value: rows are dealt by range and written once, so that both readings see the same ranges; then each range
    numbers its own and adds the sizes of the ranges before it."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(n, *within, *order).withColumn("_p", F.spark_partition_id()))
    sizes = ranged.groupBy(*within, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*within, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(Window.partitionBy(*within)).alias("_of"))  # ranges times values at most
    own = F.row_number().over(Window.partitionBy(*within, "_p").orderBy(*order))
    joined = _same(ranged.withColumn("_rn", own), bases, [*within, "_p"])
    return joined.withColumn(name, (F.col("_base") + F.col("_rn")).cast("long")).select(*df.columns, name, *([F.col("_of").alias(total)] if total else []))


def running_total(df: DataFrame, order: Sequence[str | Column], value: str, name: str, within: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row of a total order, within each value of ``within``; as with
    numbered() a value's rows are dealt over ranges, which add the sums of the ranges before them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(n, *within, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy(*within, "_p").agg(F.sum(value).alias("_n"))
    before = Window.partitionBy(*within).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*within, "_p", F.sum("_n").over(before).alias("_base"))  # ranges times values at most
    own = F.sum(value).over(Window.partitionBy(*within, "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = _same(ranged.withColumn("_rn", own), bases, [*within, "_p"])
    total = F.when(F.col("_base").isNull(), F.col("_rn")).otherwise(F.col("_base") + F.coalesce("_rn", F.lit(0)))
    return joined.withColumn(name, total.cast(sums.schema["_n"].dataType)).select(*df.columns, name)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join in which nulls equal nulls."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") if k in keys else F.col(k) for i, k in enumerate(right.columns)])
    on = [F.col(k).eqNullSafe(F.col(f"_r{right.columns.index(k)}")) for k in keys]
    return left.join(renamed, on)


def cleanup(spark: SparkSession) -> None:
    """Delete every table this process staged."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def _remove_all() -> None:
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            cleanup(spark)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        pass
