"""Record files of any size as a Spark data source: fixed-length, length-prefixed and blocked records.

``spark.read.format("records")`` plans byte ranges of the files of a folder, a file or a pattern; tasks read their ranges
through Arrow's file systems (mounted paths, HDFS, object stores) and hand on Arrow batches that are cut by offsets, not
record by record. A path of a scheme that no file system serves is refused with status 30.

Fixed-length records are numbered while planning, from the sizes of the files. A length-prefixed file can only be read
from its start, unless it is known where a record begins. So each chunk maps every place where a record may enter it to
the place where the chain of lengths leaves it: places whose four bytes look like a descriptor are linked to the next one,
and the links are doubled until all have left the chunk. One pass over these maps, which are a thousandth of the data,
finds each chunk's true entry, and then all chunks are cut at once.
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from recordloom.sources.staged import running_total, settled

#: Bytes of one task, of one read, of a chunk of length-prefixed records, and of a descriptor; the most a length can say.
SPLIT, STEP, CHUNK = 128 << 20, 8 << 20, 16 << 20
PREFIX, LONGEST = 4, 65_535
RECORDS = "position bigint, record binary"
MAPS = "file bigint, path string, start bigint, stop bigint, size bigint, enter array<bigint>, leave array<bigint>, n array<bigint>, whole array<bigint>"
RECORD_SCHEMA = pa.schema([("position", pa.int64()), ("record", pa.binary())])


def system_of(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), posixpath.abspath(path)
    try:
        scheme, _, rest = path.partition(":")
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/") if scheme == "file" else path)
    except (pa.ArrowInvalid, OSError, NotImplementedError) as e:
        raise ValueError(f"30: no file system for {path}: {e}") from e


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder, a file, or a pattern in the last part of a path, in the order of their names.
    Names that begin with a dot or an underscore are left out."""
    system, inner = system_of(path)
    folder, last = posixpath.split(inner.rstrip("/"))
    pattern = last if any(c in last for c in "*?[") else None
    base = folder if pattern else inner
    there = system.get_file_info(base)
    if there.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"35: {path}")
    found = [there] if there.type == fs.FileType.File else system.get_file_info(fs.FileSelector(base))
    named = [f for f in found if f.type == fs.FileType.File and (f is there or f.base_name[0] not in "._") and (not pattern or fnmatch.fnmatch(f.base_name, pattern))]
    scheme = path[: path.index(inner)] if inner in path and "://" in path else ""
    return sorted((scheme + f.path, f.size) for f in named)


@dataclass
class Ranges(InputPartition):
    """Pieces (path, first byte, end, number of the first record, or of the file) that one task reads."""

    pieces: list[tuple[str, int, int, int]]


def dealt(pieces: list[tuple[str, int, int, int]]) -> list[Ranges]:
    """Pieces put together, in order, up to SPLIT bytes a task; a piece of an empty file may come first."""
    out, size = [], 0
    for piece in pieces:
        if not out or size + piece[2] - piece[1] > SPLIT:
            out.append(Ranges([]))
            size = 0
        out[-1].pieces.append(piece)
        size += piece[2] - piece[1]
    return out or [Ranges([])]


def cut(data: bytes | pa.Buffer, starts: np.ndarray, ends: np.ndarray, first: int) -> pa.RecordBatch:
    """Records that lie in ``data`` from ``starts`` to ``ends``, numbered from ``first``."""
    lengths = ends - starts
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    held = np.frombuffer(data, np.uint8)
    if len(starts) and not ((starts[1:] == ends[:-1]).all() and starts[0] == 0):
        edges = np.zeros(len(held) + 1, np.int8)
        edges[starts] += 1
        edges[ends] -= 1
        held = held[np.cumsum(edges[:-1], dtype=np.int8) > 0]
    records = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(held))])
    return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(starts), dtype=np.int64)), records], schema=RECORD_SCHEMA)


class FixedReader(DataSourceReader):
    """Records of one length. A short last record is padded ("pad"), left out ("drop") or refused ("fail", status 39)."""

    def __init__(self, options: dict):
        self.path, self.length, self.ragged = options["path"], int(options["recordlength"]), options.get("ragged", "pad")
        self.fill = bytes.fromhex(options.get("pad", "20"))
        if self.length < 1:
            raise ValueError(f"39: record length {self.length}")

    def partitions(self) -> list[InputPartition]:
        pieces, first = [], 0
        step = max(1, SPLIT // self.length) * self.length
        for path, size in list_files(self.path):
            if size % self.length and self.ragged == "fail":
                raise ValueError(f"39: {path}: {size} bytes are no whole number of records of {self.length}")
            end = size // self.length * self.length if self.ragged == "drop" else size
            pieces += [(path, at, min(at + step, end), first + at // self.length) for at in range(0, end, step)]
            first += -(-end // self.length)
        return dealt(pieces)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        step = max(1, STEP // self.length) * self.length
        for path, start, end, first in partition.pieces:
            system, inner = system_of(path)
            with system.open_input_file(inner) as f:
                for at in range(start, end, step):
                    data = f.read_at(min(step, end - at), at)
                    if short := -len(data) % self.length:
                        data += self.fill * short
                    starts = np.arange(0, len(data), self.length)
                    yield cut(data, starts, starts + self.length, first + (at - start) // self.length)


def descriptors(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, length) of the places among the first ``n`` where four bytes look like a descriptor: a length of four at
    least, and two zero bytes."""
    n = min(n, len(data) - PREFIX + 1)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero((data[2 : n + 2] | data[3 : n + 3]) == 0)
    length = data[at].astype(np.int64) * 256 + data[at + 1]
    return at[length >= PREFIX], length[length >= PREFIX]


def chunk_map(data: np.ndarray, n: int, left: int) -> tuple[np.ndarray, ...]:
    """Of a chunk of ``n`` bytes (``data`` reaches on for a descriptor; ``left`` bytes are left in the file from its start):
    (entry, exit, records begun, end of the last whole one) for all entries that a record from before may lead to. An exit
    of -1 is a chain that a wrong descriptor breaks, or the end of the file tears."""
    at, length = descriptors(data, n)
    count = len(at)
    leaves, broken = count, count + 1  # two more places: beyond the chunk, and nowhere
    target = at + length
    to = np.searchsorted(at, target)
    to = np.where((to < count) & (at[np.minimum(to, max(count - 1, 0))] == target), to, broken) if count else to
    to = np.where(target >= n, np.where(target <= left, leaves, broken), to)
    jump, out = np.append(to, [leaves, broken]), np.append(np.where(to == leaves, target, -1), [-1, -1])
    steps = np.append((to != broken).astype(np.int64), [0, 0])  # whole records; one that leads nowhere still may be whole
    whole = np.append(np.where(to == broken, np.where(target <= left, target, at), target), [-1, -1])
    steps[:count] += (to == broken) & (target <= left)
    while (jump[:count] < count).any():  # each round doubles the links followed
        on = jump[:count] < count
        nxt = jump[:count][on]
        where = np.flatnonzero(on)
        new_steps, new_out, new_whole, new_jump = steps[where] + steps[nxt], out[nxt], whole[nxt], jump[nxt]
        steps[where], out[where], whole[where], jump[where] = new_steps, new_out, new_whole, new_jump
    entries = at <= LONGEST
    return at[entries], out[:count][entries], steps[:count][entries], whole[:count][entries]


class MapReader(DataSourceReader):
    """A row of MAPS for each chunk of length-prefixed files."""

    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkbytes", CHUNK))
        if self.chunk <= LONGEST:
            raise ValueError(f"chunkBytes must be beyond {LONGEST}")

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.path)
        return dealt([(path, at, min(at + self.chunk, size), k) for k, (path, size) in enumerate(files) for at in range(0, max(size, 1), self.chunk)])

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, start, stop, file in partition.pieces:
            system, inner = system_of(path)
            with system.open_input_file(inner) as f:
                size = f.size()
                data = np.frombuffer(f.read_at(min(stop - start + PREFIX - 1, size - start), start), np.uint8) if size else np.zeros(0, np.uint8)
            enter, leave, n, whole = chunk_map(data, stop - start, size - start)
            yield file, path, start, stop, size, (enter + start).tolist(), np.where(leave < 0, -1, leave + start).tolist(), n.tolist(), (whole + start).tolist()


class RecordWriter(DataSourceArrowWriter):
    """Part files in a folder, which become visible together; a whole folder is replaced on overwrite, added to otherwise."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.length, self.variable = options["path"], options.get("recordlength"), options.get("variable") == "true"
        self.fill, self.block = bytes.fromhex(options.get("pad", "20")), int(options.get("blockbytes", 0))
        system, inner = system_of(self.path)
        system.create_dir(inner, recursive=True)
        names = [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
        self.old, self.generation = names if overwrite else [], 1 + max((int(posixpath.basename(n).split("-")[1]) for n in names if posixpath.basename(n).startswith("part-")), default=-1)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, (system, inner) = TaskContext.get(), system_of(self.path)
        path = f"{inner}/_part-{self.generation:06d}-{context.partitionId():06d}-{context.taskAttemptId()}"
        with system.open_output_stream(path) as f:
            for batch in batches:
                column = batch["record"].fill_null(b"")
                offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
                data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
                f.write((prefixed(data, offsets, self.block) if self.variable else padded(data, offsets, int(self.length), self.fill)).tobytes())
        message = WriterCommitMessage()
        message.path = path
        return message

    def commit(self, messages: list) -> None:
        system, _ = system_of(self.path)
        for path in self.old:
            system.delete_file(path)
        for m in filter(None, messages):
            folder, name = posixpath.split(m.path)
            system.move(m.path, f"{folder}/{name[1:]}")

    def abort(self, messages: list) -> None:
        system, _ = system_of(self.path)
        for m in filter(None, messages):
            if system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


def padded(data: np.ndarray, offsets: np.ndarray, length: int, fill: bytes) -> np.ndarray:
    """Records cut or padded to ``length``, one after the other."""
    out = np.full((len(offsets) - 1, length), fill[0], np.uint8)
    size = np.minimum(offsets[1:] - offsets[:-1], length)
    there = np.arange(length) < size[:, None]
    out[there] = data[(offsets[:-1, None] + np.arange(length))[there]]
    return out.reshape(-1)


def prefixed(data: np.ndarray, offsets: np.ndarray, block: int = 0) -> np.ndarray:
    """Records behind their descriptors; with ``block``, in blocks of so many bytes at most, each behind its own."""
    size = offsets[1:] - offsets[:-1] + PREFIX
    if len(size) and size.max() > (block - PREFIX if block else LONGEST):
        raise ValueError(f"34: a record of {size.max() - PREFIX} bytes")
    ends, starts = np.cumsum(size), [0]
    while block and starts[-1] < len(size):  # greedy: as many records as the block holds
        before = ends[starts[-1] - 1] if starts[-1] else 0
        starts.append(int(np.searchsorted(ends, before + block - PREFIX, side="right")))
    firsts = np.array(starts[:-1], np.int64)
    extra = np.zeros(len(size), np.int64)
    extra[firsts] = PREFIX
    at = ends - size + np.cumsum(extra)
    out = np.zeros(int(size.sum() + extra.sum()), np.uint8)
    out[at], out[at + 1] = size >> 8, size & 255
    if len(firsts):
        held = np.add.reduceat(size, firsts) + PREFIX
        out[at[firsts] - PREFIX], out[at[firsts] - PREFIX + 1] = held >> 8, held & 255
    inside = np.repeat(at + PREFIX - offsets[:-1], size - PREFIX) + np.arange(offsets[0], offsets[-1])
    out[inside] = data[offsets[0] : offsets[-1]]
    return out


class RecordFiles(DataSource):
    """Format ``records``: (position long, record binary), positions counting from 0 over the files in order.

    Options: recordLength, ragged (pad, drop, fail) and pad (hex) for fixed records; for writing, variable=true writes
    descriptors and blockBytes blocks. Reading with scan=maps gives the rows of MAPS; read_variable() uses them.
    """

    @classmethod
    def name(cls) -> str:
        return "records"

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> str:
        return MAPS if self._options().get("scan") == "maps" else RECORDS

    def reader(self, schema: object) -> DataSourceReader:
        options = self._options()
        return MapReader(options) if options.get("scan") == "maps" else FixedReader(options)

    def writer(self, schema: object, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self._options(), overwrite)


def read_fixed(spark: SparkSession, path: str, length: int, ragged: str = "pad", pad: bytes = b" ") -> DataFrame:
    """Sequential scan of (position, record): a short last record of a file is padded ("pad"), left out ("drop", as keyed
    files are loaded) or refused ("fail"), whatever the file's size. Positions count records over all files, in order."""
    spark.dataSource.register(RecordFiles)
    return spark.read.format("records").option("recordLength", length).option("ragged", ragged).option("pad", pad.hex()).load(path)


def _entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The true entry of each chunk, from chunks in order: the exit of the one before. (file, path, entry, stop, before,
    n, torn): ``stop`` is where the last whole record ends, ``before`` counts the file's records up to the chunk, and
    ``torn`` is the place of a descriptor that is wrong or reaches beyond the file."""
    schema = pa.schema([("file", pa.int64()), ("path", pa.string()), ("entry", pa.int64()), ("stop", pa.int64()), ("before", pa.int64()), ("n", pa.int64()), ("torn", pa.int64())])
    file, entry, before = None, 0, 0
    for batch in batches:
        out = []
        places = batch["enter"]
        for i, (own, path, stop, size) in enumerate(zip(*(batch[c].to_pylist() for c in ("file", "path", "stop", "size")), strict=True)):
            if own != file:
                file, entry, before = own, 0, 0
            if entry is None or entry >= stop:  # broken before, or a record that spans the chunk
                if size == 0:
                    out.append((own, path, 0, 0, 0, 0, None))
                continue
            enter = np.asarray(places[i].values)
            k = int(np.searchsorted(enter, entry))
            if k == len(enter) or enter[k] != entry:
                out.append((own, path, entry, entry, before, 0, entry))
                entry = None
                continue
            leave, n, whole = (batch[c][i].values[k].as_py() for c in ("leave", "n", "whole"))
            out.append((own, path, entry, whole, before, n, whole if leave < 0 else None))
            entry, before = (None if leave < 0 else leave), before + n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _chained(data: np.ndarray, at: int, end: int) -> np.ndarray:
    """Where the records of a chain begin."""
    raw, found = data.tobytes(), []
    while at < end:
        found.append(at)
        at += raw[at] << 8 | raw[at + 1]
    return np.array(found, np.int64)


def _cut_chunks(batches: Iterator[pa.RecordBatch], blocked: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, entry, stop, first in zip(*(batch[c].to_pylist() for c in ("path", "entry", "stop", "first")), strict=True):
            if stop <= entry:
                continue
            system, inner = system_of(path)
            with system.open_input_file(inner) as f:
                data = np.frombuffer(f.read_at(stop - entry, entry), np.uint8)
            at = _chained(data, 0, len(data))
            if blocked:
                ends = np.append(at[1:], len(data))
                at = np.concatenate([_inside(data, int(a) + PREFIX, int(e), path, entry) for a, e in zip(at, ends, strict=True)])
            lengths = data[at].astype(np.int64) * 256 + data[at + 1]
            yield cut(data.tobytes(), at + PREFIX, at + lengths, first)


def _inside(data: np.ndarray, at: int, end: int, path: str, entry: int) -> np.ndarray:
    """Where the records of a block begin; they must fill it."""
    found = []
    while at + PREFIX <= end:
        size = int(data[at]) << 8 | int(data[at + 1])
        if size < PREFIX:
            break
        found.append(at)
        at += size
    if at != end:
        raise ValueError(f"39: {path}: the block before byte {entry + end} is not filled by its records")
    return np.array(found, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of blocks with the number of records in them."""
    for batch in batches:
        n = [sum(r.num_rows for r in _cut_chunks([batch.slice(i, 1)], True)) for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in batch.schema.names if c != "n"], pa.array(n, pa.int64())], [*[c for c in batch.schema.names if c != "n"], "n"])


def chunks_of(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(file, path, entry, stop, before, n, torn): the whole records of each chunk, from its true entry on. Written once."""
    spark.dataSource.register(RecordFiles)
    maps = spark.read.format("records").option("scan", "maps").option("chunkBytes", chunk).load(path)
    ordered = maps.repartition("file").sortWithinPartitions("file", "start")
    return settled(ordered.mapInArrow(_entered, "file bigint, path string, entry bigint, stop bigint, before bigint, n bigint, torn bigint"))


def variable_status(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """(path, records, file_status) of length-prefixed files, records being blocks where the file has them: 00; 04 where
    the last record reaches beyond the file's end; 39 where a descriptor is none."""
    per_file = chunks_of(spark, path, chunk).groupBy("path").agg(F.sum("n").alias("records"), F.max("torn").alias("torn"))
    return per_file.mapInArrow(_judged, "path string, records bigint, file_status string")


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        status = []
        for path, torn in zip(batch["path"].to_pylist(), batch["torn"].to_pylist(), strict=True):
            wrong = False
            if torn is not None:
                system, inner = system_of(path)
                with system.open_input_file(inner) as f:
                    head = f.read_at(min(PREFIX, f.size() - torn), torn)
                wrong = len(head) == PREFIX and bool(head[2] or head[3] or (head[0] << 8 | head[1]) < PREFIX)
            status.append("00" if torn is None else "39" if wrong else "04")
        yield pa.RecordBatch.from_arrays([batch["path"], batch["records"], pa.array(status, pa.string())], ["path", "records", "file_status"])


def read_variable(spark: SparkSession, path: str, blocked: bool = False, torn: str = "fail", chunk: int = CHUNK) -> DataFrame:
    """(position, record) of records behind a four-byte descriptor: big-endian length with the descriptor, and two zero
    bytes; ``blocked`` files have such a descriptor before each block of records too. Positions count records over all
    files, in order. A file whose chain of descriptors breaks is refused (status 39), or with ``torn`` "drop" read up to
    the break. Chunks of a file are cut by as many tasks as there are."""
    chunks = chunks_of(spark, path, chunk)
    if torn == "fail" and (broken := chunks.filter("torn is not null").select("path", "torn").first()):
        raise ValueError(f"39: {broken['path']}: no whole record at byte {broken['torn']}")
    spread = max(1, min(chunks.count(), 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if blocked:
        first = chunks.withColumn("first", F.lit(0).cast("long")).repartition(spread, "file", "entry")
        chunks = settled(first.mapInArrow(_counted, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first.schema if f.name != "n") + ", n bigint"))
    numbered = running_total(chunks.select("file", "path", "entry", "stop", "n"), ["file", "entry"], "n", "total")
    placed = numbered.withColumn("first", F.col("total") - F.col("n")).repartition(spread, "file", "entry")
    return placed.select("path", "entry", "stop", "first").mapInArrow(_blocks if blocked else _plain, RECORDS)


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_chunks(batches, False)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _cut_chunks(batches, True)


def write_fixed(df: DataFrame, path: str, length: int, mode: str = "overwrite", pad: bytes = b" ") -> None:
    """OPEN OUTPUT ("overwrite") or EXTEND ("append"): records are padded or cut to ``length``."""
    _write(df, mode).option("recordLength", length).option("pad", pad.hex()).save(path)


def write_variable(df: DataFrame, path: str, mode: str = "overwrite", block: int = 0) -> None:
    """Records behind descriptors; BLOCK CONTAINS ``block`` CHARACTERS puts them in blocks of so many bytes at most."""
    _write(df, mode).option("variable", "true").option("blockBytes", block).save(path)


def _write(df: DataFrame, mode: str):
    df.sparkSession.dataSource.register(RecordFiles)
    return df.select(F.lit(0).cast("long").alias("position"), F.col("record").cast("binary").alias("record")).write.format("records").mode(mode)
