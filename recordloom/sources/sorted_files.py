"""Sorted stores: rows in the order of their keys over Parquet files, with a directory of the files.

The directory has a row for each file: its least and greatest key, its number of rows and the number of all rows up to it.
So a point read, START and READ NEXT open the files that can hold their keys, and a positioned fetch opens one file and
takes the row by its place in it: sorting happens once, when the store is written. Parquet's Bloom filters on the first
key and its statistics prune within a file. The directory is held on the driver, as Spark's own file index is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.staged import running_total

#: Requests that are looked up in the directory one by one; more of them are joined with all files.
MOST_REQUESTS = 10_000


def _orderly(key: Sequence[object]) -> tuple:
    return tuple((x is not None, x) for x in key)


class SortedStore:
    """Rows by ``keys``. Rows of one key are in the order of ``ties``, and a key that many rows have goes over several
    files if there are ties."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        directory = spark.read.parquet(f"{path}/_directory")
        self.keys = [f.name for f in directory.schema["least"].dataType.fields]
        self.files = sorted(directory.collect(), key=lambda r: r["upto"])
        self.total = self.files[-1]["upto"] if self.files else 0
        self.schema = spark.read.parquet(f"{path}/data").schema

    @classmethod
    def write(cls, df: DataFrame, path: str, keys: Sequence[str], ties: Sequence[str] = (), files: int | None = None) -> SortedStore:
        spark = df.sparkSession
        n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = [*keys, *ties]
        sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
        sorted_rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{keys[0]}", "true").parquet(f"{path}/data")
        key = F.struct(*keys)
        placed = spark.read.schema(df.schema).parquet(f"{path}/data").withColumn("_file", F.col("_metadata.file_path"))
        per_file = placed.groupBy(F.col("_file").alias("file")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("greatest"), F.min(F.struct(*order)).alias("begins"))
        running_total(per_file, ["begins", "file"], "n", "upto").drop("begins").write.mode("overwrite").parquet(f"{path}/_directory")
        return cls(spark, path)

    def frame(self, files: Sequence[object] | None = None) -> DataFrame:
        """The rows of some files of the directory, of all by default."""
        names = [f["file"] for f in (self.files if files is None else files)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*names) if names else self.spark.createDataFrame([], self.schema)

    def holding(self, values: Sequence[object]) -> list:
        """The files whose range of keys has these values of the first keys."""
        v, n = _orderly(values), len(values)
        return [f for f in self.files if _orderly(f["least"][:n]) <= v <= _orderly(f["greatest"][:n])]

    def read(self, *values: object) -> DataFrame:
        """READ by the first keys: the rows with these values."""
        rows = self.frame(self.holding(values))
        for key, value in zip(self.keys, values, strict=False):
            rows = rows.filter(F.col(key).eqNullSafe(F.lit(value)))
        return rows

    def read_keys(self, requests: DataFrame) -> DataFrame:
        """Every request (the key columns and others) with the store's columns and file_status 00 or 23. Few requests open
        the files that can hold them; more than MOST_REQUESTS are joined with all."""
        few = requests.select(*self.keys).distinct().limit(MOST_REQUESTS + 1).collect()
        files = self.files
        if len(few) <= MOST_REQUESTS:
            wanted = {f["file"] for r in few for f in self.holding(r)}
            files = [f for f in self.files if f["file"] in wanted]
        found = self.frame(files).withColumn("_hit", F.lit(True))
        return requests.join(found, self.keys, "left").withColumn("file_status", F.when(F.col("_hit"), "00").otherwise("23")).drop("_hit")

    def start(self, relation: str, value: object) -> tuple[DataFrame, str]:
        """START on the first key: the rows from the position on, in order, and 00 or 23. But for equality (and where
        only nulls are beside it) the directory alone gives the status."""
        key, v = self.keys[0], _orderly([value])
        low, high = (lambda f: _orderly(f["least"][:1])), (lambda f: _orderly(f["greatest"][:1]))
        test: dict[str, tuple] = {"=": (lambda f: low(f) <= v <= high(f), F.col(key) == value), ">=": (lambda f: high(f) >= v, F.col(key) >= value), ">": (lambda f: high(f) > v, F.col(key) > value), "<=": (lambda f: low(f) <= v, F.col(key) <= value), "<": (lambda f: low(f) < v, F.col(key) < value)}
        keep, condition = test[relation]
        files = [f for f in self.files if keep(f)]
        rows = self.frame(files).filter(condition)
        sure = relation != "=" and any(f["least" if "<" in relation else "greatest"][0] is not None for f in files)
        there = sure or bool(files) and not rows.isEmpty()
        return rows.orderBy(*self.keys), "00" if there else "23"

    def read_next(self, n: int, after: object | None = None) -> DataFrame:
        """The ``n`` rows after a value of the first key, from as few files as are sure to hold them."""
        return self._run(n, after, self.files, "greatest", lambda a, b: a > b, [F.asc(k) for k in self.keys], lambda c: c > after)

    def read_previous(self, n: int, before: object | None = None) -> DataFrame:
        return self._run(n, before, self.files[::-1], "least", lambda a, b: a < b, [F.desc(k) for k in self.keys], lambda c: c < before)

    def _run(self, n: int, bound: object, files: list, edge: str, beyond: object, order: list[Column], condition: object) -> DataFrame:
        picked, sure = [], 0
        other = "least" if edge == "greatest" else "greatest"
        for f in files:
            if bound is not None and not beyond(_orderly(f[edge][:1]), _orderly([bound])):
                continue
            picked.append(f)
            sure += f["n"] if bound is None or beyond(_orderly(f[other][:1]), _orderly([bound])) else 0
            if sure >= n:
                break
        rows = self.frame(picked)
        return (rows if bound is None else rows.filter(condition(F.col(self.keys[0])))).orderBy(*order).limit(n)

    def slice(self, first: int, last: int) -> DataFrame:
        """The rows of ranks ``first`` to ``last``, with their ``rank`` (from 1), from the files that hold them."""
        files = [f for f in self.files if f["upto"] >= first and f["upto"] - f["n"] < last]
        return self.ranked(files).filter(F.col("rank").between(first, last))

    def ranked(self, files: list | None = None) -> DataFrame:
        """The rows with their ``rank`` in the order of the store."""
        files = self.files if files is None else files
        base = self.spark.createDataFrame([(f["file"], f["upto"] - f["n"]) for f in files], "_file string, _base bigint")
        rows = self.frame(files).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        return rows.join(F.broadcast(base), "_file").select(*self.schema.names, (F.col("_base") + F.col("_row") + 1).alias("rank"))  # a row for each file

    def fetch(self, position: int) -> DataFrame:
        """The row at a position; negative ones count from the end. None or one row."""
        at = position if position > 0 else self.total + 1 + position
        return self.slice(at, at).drop("rank") if position and 1 <= at <= self.total else self.frame([])

    def fetch_many(self, positions: DataFrame, position: str) -> DataFrame:
        """Every row of ``positions`` with the store's row at its position, null beyond the ends."""
        at = F.when(F.col(position) < 0, F.lit(self.total + 1) + F.col(position)).otherwise(F.col(position))
        return positions.withColumn("rank", at).join(self.ranked(), "rank", "left").drop("rank")
