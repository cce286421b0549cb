"""Best-fit packing by minimum bin slack.

A bin takes the longest length that is left; a bitset subset-sum programme over the lengths still available (each as
often as it is left) then finds the fullest feasible rest, which is removed. Items of one length are alike, so the
programme runs on the histogram of lengths, at most one entry for each length up to the capacity, on the driver; one
combination is removed as many times as the histogram allows at once, so every removal uses up some length and there
are at most ``capacity`` of them, however many items there are.

Items are numbered within their length without bringing a length together: a task numbers its own, a window over the
counts of (length, task) adds the numbers before, and the table of combinations (bounded by the capacity) turns a
number into a bin and a place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.staging import stage
from recordloom.llm.textblocks import slices, tidy
from recordloom.llm.tokens import binaries, encoder_of

CAPACITY = 2048


def fullest(available: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths and times whose sum is as near to ``room`` as possible, from below; longer lengths are tried first."""
    reach, mask, tried = 1, (1 << (room + 1)) - 1, []
    for length in sorted(available, reverse=True):
        most, part = min(available[length], room // length), 1
        while most > 0:
            take = min(part, most)
            tried.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            most, part = most - take, part * 2
        if reach >> room & 1:
            break
    left, times = reach.bit_length() - 1, {}
    for length, take, before in reversed(tried):
        if not before >> left & 1:
            left -= length * take
            times[length] = times.get(length, 0) + take
    return sorted(times.items(), reverse=True)


def combinations(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """(lengths with times, number of bins) until every item of the histogram is placed."""
    left, out = {k: v for k, v in counts.items() if v}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        times = dict(fullest({k: v for k, v in left.items() if v and k <= capacity - longest}, capacity - longest)) if longest < capacity else {}
        left[longest] += 1
        times[longest] = times.get(longest, 0) + 1
        bins = min(left[k] // n for k, n in times.items())
        for k, n in times.items():
            left[k] -= n * bins
            if not left[k]:
                del left[k]
        out.append((sorted(times.items(), reverse=True), bins))
    return out


def _table(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first number, times in a bin, first bin, offset), by length and number."""
    rows, used, bin_ = [], dict.fromkeys(counts, 0), 0
    for times, bins in combinations(counts, capacity):
        offset = 0
        for length, n in times:
            rows.append((length, used[length], n, bin_, offset))
            used[length] += n * bins
            offset += length * n
        bin_ += bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _placed(table: np.ndarray, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = (table[:, 0] << shift) + table[:, 1]
        for batch in batches:
            length, number = batch["length"].to_numpy(), batch["number"].to_numpy()
            row = table[np.searchsorted(keys, (length << shift) + number, "right") - 1]
            nth = number - row[:, 1]
            columns = {name: batch[name] for name in batch.schema.names if name != "number"}
            columns |= {"sequence_id": pa.array(row[:, 3] + nth // row[:, 2]), "offset": pa.array(row[:, 4] + nth % row[:, 2] * length)}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the task's number and the row's number among the task's rows of its length."""
    block, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
    for batch in batches:
        length = batch["length"].to_numpy()
        if len(length):
            seen = np.pad(seen, (0, max(0, int(length.max()) + 1 - len(seen))))
        order = np.argsort(length, kind="stable")
        counts = np.bincount(length, minlength=len(seen))
        nth = np.empty(len(length), np.int64)
        nth[order] = np.arange(len(length)) - np.repeat(np.cumsum(counts) - counts, counts)
        nth += seen[length]
        seen = seen + counts
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), block, np.int32)), pa.array(nth)], [*batch.schema.names, "block", "nth"])


def pack(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset (long) to items with a column ``length`` (long, 1 to capacity).

    Every row keeps its other columns. Equal rows are items of their own, and of items of one length any may come
    first. No rows in, no rows out. A length that is
    null or out of range is an error. Columns named block, nth, number, sequence_id or offset are replaced.
    """
    items = items.drop("block", "nth", "number", "sequence_id", "offset")
    kept = items.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length").cast("long")).otherwise(F.raise_error(F.lit("length out of range")).cast("long")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    numbered = stage(kept.mapInArrow(tidy(_numbered), f"{fields}, block int, nth long"), "items")
    per_block = stage(numbered.groupBy("length", "block").count(), "lengths")
    counts = {r["length"]: r["n"] for r in per_block.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `capacity` rows
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_block.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    ranked = numbered.join(bases, ["length", "block"]).select(*kept.columns, (F.col("base") + F.col("nth")).alias("number"))
    return ranked.mapInArrow(tidy(_placed(_table(counts, capacity), 48)), f"{fields}, sequence_id long, offset long")


def _cut(path: str, end: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for whole in batches:
            for batch in slices(whole, size=4_000_000):
                ids, starts = encoder.encode(batch["text"], end)
                n = np.diff(starts)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[doc] - start, capacity)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binaries(ids, np.concatenate([[0], np.cumsum(length)]))],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise whole texts, end each document with ``end``, and cut only what is longer than the capacity.

    doc_id long, piece int, start long, length long, ids binary (little-endian unsigned 32 bit). A null or empty
    text is one piece that holds ``end``; a null doc_id stays null. A very long text gives as many pieces as it needs.
    Other columns are ignored; rows that repeat a doc_id give pieces each; an empty table gives none.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_cut(tokenizer_path, end, capacity)), "doc_id long, piece int, start long, length long, ids binary")
