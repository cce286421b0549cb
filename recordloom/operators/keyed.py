"""Keyed files as DataFrames: load, point reads, browsing, maintenance and table lookup, with status codes.

Keys that are read or changed come as a DataFrame, so a run of a thousand keys is one join, not a thousand jobs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.sources.records import read_fixed, write_fixed
from recordloom.sources.staged import numbered, settled

#: Bytes of a table that may be broadcast.
MOST_BYTES = 64 * 1024 * 1024


def load_last(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of rows with the same key the one at the greatest position."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), position).alias("last")).select(*keys, "last.*")


def persist_order(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.orderBy(*keys)


def read_keys(requests: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """Every request with the store's columns and ``file_status`` 00 or 23."""
    found = store.withColumn("_hit", F.lit(True))
    return requests.join(found, keys, "left").withColumn("file_status", F.when(F.col("_hit"), "00").otherwise("23")).drop("_hit")


def insert(store: DataFrame, rows: DataFrame, keys: list[str], sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new store, rows with file_status 00 or 22). Of rows with one key the first is stored, and the others are
    duplicates: the first by ``sequence``, or by all other columns."""
    known = store.select(*keys).distinct().withColumn("_hit", F.lit(True))
    order = [sequence] if sequence else [c for c in rows.columns if c not in keys] or keys
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    judged = rows.withColumn("_nth", nth).join(known, keys, "left")
    judged = judged.withColumn("file_status", F.when(F.col("_hit") | (F.col("_nth") > 1), "22").otherwise("00")).drop("_hit", "_nth")
    accepted = judged.filter("file_status = '00'").drop("file_status")
    return store.unionByName(accepted.select(*store.columns)), judged


def update(store: DataFrame, changes: DataFrame, keys: list[str], sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(new store with the changed columns, changes with file_status 00 or 23). Of changes of one key the last counts:
    by ``sequence``, which is no column of the store, or by the changed values."""
    columns = [c for c in changes.columns if c not in keys and c != sequence]
    new = F.struct(*columns)
    changed = changes.groupBy(*keys).agg(F.max_by(new, sequence).alias("_new") if sequence else F.max(new).alias("_new"))
    values = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in store.columns]
    return store.join(changed, keys, "left").select(*values), read_keys(changes, store.select(*keys).distinct(), keys)


def delete(store: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new store, requests with file_status 00 or 23)."""
    return store.join(requests.select(*keys).distinct(), keys, "left_anti"), read_keys(requests, store.select(*keys), keys)


def start(store: DataFrame, key: str, relation: str, value: object) -> tuple[DataFrame, str]:
    """START: the rows from the position on, ascending by key, and the status (23 if there are none)."""
    test = {"=": F.col(key) == value, ">=": F.col(key) >= value, ">": F.col(key) > value, "<=": F.col(key) <= value, "<": F.col(key) < value}[relation]
    rows = store.filter(test)
    return rows.orderBy(key), "00" if rows.limit(1).count() else "23"


def read_next(store: DataFrame, key: str, n: int = 1, after: object | None = None) -> DataFrame:
    rows = store if after is None else store.filter(F.col(key) > after)
    return rows.orderBy(key).limit(n)


def read_previous(store: DataFrame, key: str, n: int = 1, before: object | None = None) -> DataFrame:
    rows = store if before is None else store.filter(F.col(key) < before)
    return rows.orderBy(F.desc(key)).limit(n)


def fetch(rows: DataFrame, order: list[str], position: int, relative_to: int = 0) -> DataFrame:
    """FETCH ABSOLUTE (or RELATIVE to a position); negative positions count from the end. Near positions are an ordered
    top-k; others are found in rows that are numbered range by range."""
    at = position + relative_to
    if at == 0:
        return rows.limit(0)
    by = [F.col(c) if at > 0 else F.desc(c) for c in order]
    if abs(at) > 10_000:
        return numbered(rows, by, "_rn").filter(F.col("_rn") == abs(at)).drop("_rn")
    head = rows.orderBy(*by).limit(abs(at))
    return head.withColumn("_rn", F.row_number().over(Window.orderBy(*by))).filter(F.col("_rn") == abs(at)).drop("_rn")


def relative_record(df: DataFrame, position: str) -> DataFrame:
    """Relative files: the record number (from 1) of each record from its position (from 0), as read_fixed() counts it
    over all files of a folder."""
    return df.withColumn("record_number", F.col(position) + 1)


class RelativeFile:
    """Records by number (from 1) in slots of one length, over any number of files. Which slots are empty is kept beside the
    records, as bitmaps of 32,768 slots each, so DELETE leaves the records where they are; a slot beyond the end is empty.

    The bitmaps of each change are a new folder, read once it is complete; readers of record files don't see them."""

    def __init__(self, spark: SparkSession, path: str, length: int):
        self.spark, self.path, self.length = spark, path, length

    def load(self, records: DataFrame) -> None:
        """OPEN OUTPUT: records (record_number, record); numbers that are missing are empty slots."""
        last = records.agg(F.max("record_number")).first()[0] or 0
        slots = self.spark.range(1, last + 1).select(F.col("id").alias("record_number"))
        whole = settled(slots.join(records.select("record_number", "record", F.lit(True).alias("_there")), "record_number", "left"))
        write_fixed(whole.repartitionByRange("record_number").sortWithinPartitions("record_number"), self.path, self.length)
        self._save(whole.filter("_there is null").select("record_number"), None)

    def _versions(self) -> list[str]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_empty")
        fs = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = [f.getPath() for f in fs.listStatus(where) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))] if fs.exists(where) else []
        return sorted(p.getName() for p in done)

    def _save(self, empty: DataFrame, old: DataFrame | None) -> None:
        """New bitmaps: the empty slots of before, and those of ``empty``."""
        at = F.col("record_number") - 1
        bits = empty.groupBy(F.call_function("bitmap_bucket_number", at).alias("bucket")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", at)).alias("bits"))
        if old is not None:
            bits = old.unionByName(bits).groupBy("bucket").agg(F.call_function("bitmap_or_agg", F.col("bits")).alias("bits"))
        version = int((self._versions() or ["0"])[-1]) + 1
        bits.write.parquet(f"{self.path}/_empty/{version:012d}")

    def empty(self) -> DataFrame:
        """(bucket, bits) of the empty slots."""
        versions = self._versions()
        schema = "bucket bigint, bits binary"
        return self.spark.read.schema(schema).parquet(f"{self.path}/_empty/{versions[-1]}") if versions else self.spark.createDataFrame([], schema)

    def _judged(self, requests: DataFrame) -> DataFrame:
        """Requests (record_number, …) with ``_empty``: whether the bitmaps say so."""
        at = F.col("record_number") - 1
        bucket, bit = F.call_function("bitmap_bucket_number", at), F.call_function("bitmap_bit_position", at)
        byte = F.conv(F.hex(F.substr("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        joined = requests.withColumn("bucket", bucket).withColumn("_bit", bit).join(self.empty(), "bucket", "left").withColumn("_byte", F.coalesce(byte, F.lit(0)))
        return joined.withColumn("_empty", F.expr("bit_get(_byte, cast(_bit % 8 as int)) = 1")).drop("bucket", "bits", "_bit", "_byte")

    def read(self) -> DataFrame:
        """READ NEXT over the file: (record_number, record) of the slots that hold a record."""
        records = relative_record(read_fixed(self.spark, self.path, self.length), "position").select("record_number", "record")
        return self._judged(records).filter(~F.col("_empty")).drop("_empty")

    def read_at(self, requests: DataFrame) -> DataFrame:
        """Every request with its record and file_status 00 or 23."""
        return read_keys(requests, self.read(), ["record_number"])

    def delete(self, requests: DataFrame) -> DataFrame:
        """Requests with file_status: 00 for a slot that held a record and is empty now, 23 for others."""
        judged = settled(self.read_at(requests).drop("record"))
        old = settled(self.empty())
        self._save(judged.filter("file_status = '00'").select("record_number").distinct(), old)
        return judged


def maintain(store: DataFrame, transactions: DataFrame, key: str, sequence: str, action: str, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Apply A(dd), U(pdate) and D(elete) transactions in order within each key.

    Whether a key exists before a transaction depends only on the last A or D before it that took effect; an A and a
    D always leave the key existing and missing, so existence after any A or D is known and a window gives each
    transaction's status. Then the last surviving A or U of a key wins. Returns (new store, statuses: 00, 22, 23).
    """
    known = store.select(key).withColumn("_was", F.lit(True))
    tx = transactions.join(known, key, "left")
    w = Window.partitionBy(key).orderBy(sequence)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    exists = F.when(F.col(action) == "A", True).when(F.col(action) == "D", False)
    tx = tx.withColumn("_exists", F.coalesce(F.last(exists, ignorenulls=True).over(before), F.coalesce("_was", F.lit(False))))
    status = F.when((F.col(action) == "A") & F.col("_exists"), "22").when(F.col(action).isin("U", "D") & ~F.col("_exists"), "23").otherwise("00")
    tx = tx.withColumn("file_status", status)
    done = tx.filter("file_status = '00'")
    final = done.groupBy(key).agg(F.max_by(F.struct(F.col(action).alias("_action"), *payload), sequence).alias("_last"))
    joined = store.join(final, key, "full_outer")
    new = joined.filter("_last is null or _last._action <> 'D'")
    columns = [F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c) if c in payload else F.col(c) for c in store.columns]
    return new.select(*columns), tx.select(*transactions.columns, "file_status")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """SEARCH ALL: a left join with a table; it is broadcast only if its values are counted to be small."""
    wide = {f.name for f in table.schema if f.dataType.typeName() in ("string", "binary")}
    if any(f.dataType.typeName() in ("array", "map", "struct") for f in table.schema):
        return rows.join(table, on, "left")  # left to the planner
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) + 16 if c in wide else F.lit(16) for c in table.columns), F.lit(16))
    small = (table.agg(F.sum(size)).first()[0] or 0) <= most_bytes
    return rows.join(F.broadcast(table) if small else table, on, "left")


def alternate_read(store: DataFrame, alternates: list[str], requests: DataFrame, key: str) -> DataFrame:
    """READ by an alternate key with duplicates: every request with all rows that have its alternate key, numbered in
    the order of the prime key, and file_status 00, 02 (another follows) or 23."""
    other = [c for c in store.columns if c not in alternates]
    found = requests.join(store.select(*alternates, *other).withColumn("_hit", F.lit(True)), alternates, "left")
    placed = numbered(found, [key], "duplicate", requests.columns, total="_of")  # rows of a hot key are dealt by range
    status = F.when(F.col("_hit").isNull(), "23").when(F.col("duplicate") < F.col("_of"), "02").otherwise("00")
    return placed.withColumn("duplicate", F.col("duplicate").cast("int")).withColumn("file_status", status).drop("_hit", "_of")


def search(array: Column, test: object) -> Column:
    """SEARCH: the first element of an array that passes; null (AT END) if none does."""
    return F.get(F.filter(array, test), F.lit(0))
