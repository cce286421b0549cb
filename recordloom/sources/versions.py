"""Versioned stores: tables as lists of data files in a manifest that is replaced by an atomic rename.

A manifest names the files of every table of a store and the restart positions of its runs. Changes write new files and
stage a new list; nothing is visible before the commit, which renames a finished manifest to the next version's name and
fails if there is one. So a transaction over several tables is published at once or not at all, it survives the session,
and the lineage of a table is its files. Updates and deletes rewrite only the files that hold rows they change.

A run of many commits writes the rows of many of them in one job, as a list of files in order; each of its versions says
how many of the list's first rows are in the table, so a version has the same size however many there are.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.sorted_files import SortedStore


class Conflict(RuntimeError):
    """Another commit made this version."""


class VersionedStore:
    """A folder of data files and manifests; version 0 is the empty store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._lists: dict[str, list] = {}

    def _fs(self, path: str) -> tuple[object, object]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        fs, where = self._fs(f"{self.path}/_manifests")
        names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def last(self) -> int:
        """The last version; as there are no gaps it is found in a logarithm of questions."""
        fs, where = self._fs(f"{self.path}/_manifests")
        there = lambda v: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(where, f"{v:020d}.json"))
        low, high = 0, 1
        while there(high):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if there(middle) else (low, middle)
        return low

    def manifest(self, version: int | None = None) -> dict:
        """{version, tables: {name: {files, schema, lists}}, positions: {run: groups committed}} of a version, the last by
        default; ``lists`` are those of runs, with the number of their first rows that are in the table."""
        version = self.last() if version is None else version
        return self._load(f"_manifests/{version:020d}.json") if version else {"version": 0, "tables": {}, "positions": {}}

    def _load(self, name: str) -> dict:
        return json.loads("".join(r[0] for r in self.spark.read.option("wholetext", "true").text(f"{self.path}/{name}").collect()))

    def _save(self, name: str, content: dict) -> None:
        """Write a file under a name that there must not be yet: first under another one, then renamed."""
        temporary = f"{self.path}/_tmp/{uuid.uuid4().hex}"
        fs, where = self._fs(temporary)
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not fs.exists(target.getParent()):
            fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(where, target):
            fs.delete(where, False)
            raise Conflict(f"{name} is there already")

    def commit(self, manifest: dict) -> int:
        """Publish a manifest as the version after the one it was made from."""
        version = manifest["version"] + 1
        self._save(f"_manifests/{version:020d}.json", {**manifest, "version": version})
        return version

    def write_files(self, df: DataFrame) -> list[str]:
        """The data files that the rows of a frame are written to, as names under the store."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        fs, where = self._fs(f"{self.path}/{folder}")
        return sorted(f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))

    def write_list(self, df: DataFrame, order: str) -> tuple[str, int]:
        """Rows written in an order, without its column; the name of the list of their files, and the number of rows."""
        files = self.write_files(df.repartitionByRange(order).sortWithinPartitions(order).drop(order))
        rows = self.spark.read.parquet(*[f"{self.path}/{f}" for f in files]).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
        size = {r["file"]: r["n"] for r in rows.collect()}  # a row for each file
        name = f"_lists/{uuid.uuid4().hex}"
        self._save(f"{name}.json", {"files": [(f, size[f.rpartition("/")[2]]) for f in files if f.rpartition("/")[2] in size]})
        return name, sum(size.values())

    def pieces(self, table: dict) -> tuple[list[str], dict[str, int]]:
        """The files whose rows are all in a table, and those of which some first rows are, with their number."""
        whole, cut = list(table["files"]), {}
        for name, rows in table.get("lists", {}).items():
            if name not in self._lists:
                self._lists[name] = self._load(f"{name}.json")["files"]
            for file, n in self._lists[name]:
                if rows >= n:
                    whole.append(file)
                elif rows > 0:
                    cut[file] = rows
                rows -= n
        return whole, cut

    def frame(self, table: dict, file: str | None = None) -> DataFrame:
        """The rows of a manifest's entry of a table, with the name of their file as column ``file`` if that is named."""
        whole, cut = self.pieces(table)
        name = F.concat(F.lit("data/"), F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1))

        def read(files: list[str], *more: Column) -> DataFrame:
            rows = self.spark.read.schema(table["schema"]).parquet(*[f"{self.path}/{f}" for f in files])
            return rows.select("*", *([name.alias(file)] if file else []), *more)

        frames = [read(whole)] if whole else []
        for f, rows in cut.items():  # one for each run that was stopped within a file
            frames.append(read([f], F.col("_metadata.row_index").alias("_row")).filter(F.col("_row") < rows).drop("_row"))
        return reduce(DataFrame.unionByName, frames) if frames else self.spark.createDataFrame([], table["schema"] + (f", `{file}` string" if file else ""))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.frame(self.manifest(version)["tables"][name])

    def begin(self) -> Staged:
        return Staged(self, self.manifest())

    def resume(self, savepoint: str) -> Staged:
        """A transaction as it was at a savepoint, in this session or in one that has ended."""
        return Staged(self, self._load(f"_savepoints/{savepoint}.json"))


class Staged:
    """Changes of a transaction: new files and a manifest that isn't published yet."""

    def __init__(self, store: VersionedStore, manifest: dict):
        self.store, self.manifest = store, manifest

    def __getitem__(self, name: str) -> DataFrame:
        return self.store.frame(self.manifest["tables"][name])

    def _set(self, name: str, files: list[str], schema: str, lists: Mapping[str, int] | None = None) -> None:
        tables = {**self.manifest["tables"], name: {"files": files, "schema": schema, **({"lists": dict(lists)} if lists else {})}}
        self.manifest = {**self.manifest, "tables": tables}

    def create(self, name: str, df: DataFrame) -> None:
        self._set(name, self.store.write_files(df), _schema(df))

    def insert(self, name: str, rows: DataFrame) -> int:
        """Append; the number of rows."""
        table = self.manifest["tables"][name]
        columns = self[name].columns
        new = self.store.write_files(rows.select(*columns))
        self._set(name, table["files"] + new, table["schema"], table.get("lists"))
        return self.store.frame({"files": new, "schema": table["schema"]}).count()

    def update(self, name: str, values: Mapping[str, Column], where: Column) -> int:
        def change(df: DataFrame) -> DataFrame:
            return df.withColumns({c: F.when(where, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})

        return self._rewrite(name, where, change)

    def delete(self, name: str, where: Column) -> int:
        return self._rewrite(name, where, lambda df: df.filter(~F.coalesce(where, F.lit(False))))

    def _rewrite(self, name: str, where: Column, change: object) -> int:
        table = self.manifest["tables"][name]
        whole, cut = self.store.pieces(table)
        hit = self.store.frame(table, "_file").filter(where).groupBy("_file").count().collect() if whole or cut else []  # at most a row for each file
        if not hit:
            return 0
        old = {r["_file"] for r in hit} | set(cut)  # of which the rest isn't in the table
        rows = self.store.frame(table, "_file").filter(F.col("_file").isin(sorted(old))).drop("_file") if cut else self.store.frame({**table, "files": sorted(old), "lists": {}})
        new = self.store.write_files(change(rows))
        self._set(name, [f for f in whole if f not in old] + new, table["schema"])
        return sum(r["count"] for r in hit)

    def savepoint(self, name: str) -> str:
        """Keep the state under a name, also beyond the session; the name to resume() by."""
        key = f"{name}-{uuid.uuid4().hex}"
        self.store._save(f"_savepoints/{key}.json", self.manifest)
        return key

    def rollback_to(self, savepoint: str) -> None:
        self.manifest = self.store._load(f"_savepoints/{savepoint}.json")

    def rollback(self) -> None:
        self.manifest = self.store.manifest(self.manifest["version"])

    def commit(self) -> int:
        """Publish; the version. A Conflict if another commit came first."""
        version = self.store.commit(self.manifest)
        self.manifest = {**self.manifest, "version": version}
        return version


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def committed_groups(store: VersionedStore, name: str, source: SortedStore, every: int, together: int = 1) -> Iterator[int]:
    """Append the rows of ``source`` to table ``name`` in groups of ``every`` rows, ``together`` groups a commit; yields the
    groups committed so far. The number is the restart position and is part of the manifest, so a run that was stopped
    anywhere goes on with the first group that isn't committed. Rows get their ``commit_group`` (from 0).

    A job writes the rows of as many commits as the run has made so far, so there are a logarithm of jobs, and a run that is
    stopped loses no more than it has committed, or one commit. A commit publishes only the number of the rows that are in.
    Between commits others may change the store; another run of the same name is a Conflict."""
    groups = -(-source.total // every)
    staged = store.begin()
    began = done = staged.manifest["positions"].get(name, 0)
    while done < groups:
        base = staged.manifest["tables"].get(name)
        ahead = min(done + max(together, (done - began) // together * together), groups)
        rows = source.slice(done * every + 1, ahead * every).withColumn("commit_group", F.floor((F.col("rank") - 1) / every).cast("long"))
        prepared, total = store.write_list(rows.select(*staged[name].columns, "rank") if base else rows, "rank")
        schema = base["schema"] if base else _schema(rows.drop("rank"))
        first, published = done, base
        while done < ahead:
            upto = min(done + together, ahead)
            staged._set(name, base["files"] if base else [], schema, {**(base or {}).get("lists", {}), prepared: min((upto - first) * every, total)})
            staged.manifest = {**staged.manifest, "positions": {**staged.manifest["positions"], name: upto}}
            before, mine = staged.manifest["version"], staged.manifest["tables"][name]
            try:
                staged.commit()
            except Conflict:
                staged = store.begin()  # others have committed
                if staged.manifest["version"] == before or staged.manifest["positions"].get(name, 0) != done:
                    raise
                if staged.manifest["tables"].get(name) != published:
                    break  # they have changed this table: the rest is written for what it is now
                continue
            published, done = mine, upto
            yield done
