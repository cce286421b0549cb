"""Tables that cut lineage, in the folder that all machines of the cluster share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset, and only in local mode, a
temporary folder is used. Written tables are ordinary zstd Parquet, so a lost executor costs a re-read, not
a recomputation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets for each shuffle partition; numbers that the rows of one key are dealt by.
SPREAD, SALTS = 3, 256

_written: list[str] = []
_tables: list[str] = []
_local: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only for local sessions without the setting."""
    global _local
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _local = _local or tempfile.mkdtemp(prefix="recordloom-")
    return f"file://{_local}"


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back (with its known schema)."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stage(), in buckets of ``key``: joins and groupings of such tables by the key need no exchange.

    There are SPREAD buckets for each shuffle partition, as the few rows of a table of blocks fall on them unevenly.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    table = f"staged_{path.rpartition('-')[2]}"
    n = buckets(spark)
    _tables.append(table)
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(table)
    return spark.table(table)


def buckets(spark: SparkSession) -> int:
    return SPREAD * int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, how: str = "left", most: int = 200_000) -> DataFrame:
    """``rows`` joined with a table of distinct ``keys``, whatever share of the rows one key has.

    A table of ``most`` rows or fewer is broadcast. Else rows are dealt by keys and one of SALTS numbers made from
    ``spread``, and the table goes to those numbers that its keys' rows have.
    """
    table = stage(table, "table")
    if table.count() <= most:
        return rows.join(F.broadcast(table), keys, how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    parts = salted.select(*keys, "_salt").distinct().join(table, keys)
    return salted.join(parts, [*keys, "_salt"], how).drop("_salt")


def cleanup(spark: SparkSession) -> None:
    """Delete every table this process staged. Frames that still read them become unusable."""
    while _tables:
        spark.sql(f"drop table if exists {_tables.pop()}")
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
