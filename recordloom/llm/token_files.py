"""Token ids in byte-aligned variable-length files.

Ids are replaced by their rank of frequency in the corpus, and ranks are written in one to four bytes each. Four
2-bit lengths share a control byte, and control bytes stand apart from data bytes, so a reader turns a control byte
into four lengths by one table look-up and gathers the data without branching.

A file set is a folder of Parquet files written by Spark (so it works on any store Spark can write to):

* ``segments``: part int, seq int, start long (ids before the segment), doc_ids, counts, control, data binary. Rows in
  the order of (part, seq) hold documents in ascending doc_id order.
* ``ranks``: rank int, id int. The vocabulary bounds its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.ranges import cuts_of, range_of
from recordloom.llm.staging import stage
from recordloom.llm.textblocks import slices, tidy
from recordloom.llm.tokens import binaries, encoder_of

#: Stands for a null doc_id, below all others.
NO_ID = -(2**63)
#: Bytes of text in a segment, about.
SEGMENT = 4_000_000
#: For each control byte its four lengths.
LENGTHS = ((np.arange(256)[:, None] >> (2 * np.arange(4))) & 3).astype(np.uint8) + np.uint8(1)


def encode_values(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, np.uint32)
    wide = 4 if len(values) and values.max() > 0xFFFF else 2
    if wide == 2:
        values = values.astype(np.uint16)
        lengths = (1 + (values > 0xFF)).astype(np.uint8)
    else:
        lengths = (1 + (values >> 8 > 0) + (values >> 16 > 0) + (values >> 24 > 0)).astype(np.uint8)
    padded = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    padded[: len(values)] = lengths - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control, values.view(np.uint8).reshape(-1, wide)[np.arange(wide) < lengths[:, None]]


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values written by encode_values."""
    lengths = LENGTHS[control].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    out = padded[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(lengths > k)
        if not len(longer):
            break
        out[longer] |= padded[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _segments(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, inside = encoder_of(path), TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, size=SEGMENT):
                ids, starts = encoder.encode(batch["text"], end)
                counts = np.diff(starts).astype(np.uint32)
                doc_ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "inside": pa.array([inside]), "n": pa.array([len(ids)]), "doc_ids": pa.array([doc_ids.tobytes()]), "counts": pa.array([counts.tobytes()]), "seen": pa.array([np.bincount(ids).astype(np.uint32).tobytes()]), "ids": pa.array([ids.tobytes()])})
                seq, inside = seq + 1, inside + len(ids)

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for value in batch["seen"]:
            one = np.frombuffer(value.as_buffer(), np.uint32).astype(np.int64)
            if len(one) > len(total):
                one, total = total, one
            total[: len(one)] += one
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["id", "n"])


def _coded(ranks: np.ndarray, before: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            control, data = zip(*(encode_values(ranks[np.frombuffer(v.as_buffer(), np.uint32)]) for v in batch["ids"]), strict=True) if batch.num_rows else ((), ())
            columns = {c: batch[c] for c in ("part", "seq", "doc_ids", "counts")}
            columns["start"] = pa.array(before[batch["part"].to_numpy()] + batch["inside"].to_numpy())
            columns = {c: columns[c] for c in ("part", "seq", "start", "doc_ids", "counts")}
            yield pa.RecordBatch.from_pydict(columns | {"control": pa.array([c.tobytes() for c in control], pa.binary()), "data": pa.array([d.tobytes() for d in data], pa.binary())})

    return run


def _decoded(ids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                read = lambda c, kind: np.frombuffer(batch[c][k].as_buffer(), kind)  # noqa: B023, E731
                counts = read("counts", np.uint32).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(counts)])
                values = ids[decode_values(read("control", np.uint8), read("data", np.uint8), int(bounds[-1]))]
                first = batch["start"][k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(read("doc_ids", np.int64)), pa.array(first + bounds[:-1]), pa.array(counts), binaries(values, bounds)], ["doc_id", "start", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end: int) -> None:
    """Tokenise whole texts in ascending doc_id order, end each with ``end``, and write a file set to ``path``.

    A null text is empty; rows with a null doc_id come first; rows that repeat a doc_id stand side by side in any
    order. Very long texts are a segment each. An empty table writes an empty file set. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    cuts = cuts_of(rows, "doc_id", n)
    ordered = rows.withColumn("range", range_of("doc_id", cuts)).repartitionById(len(cuts) + 1, "range").sortWithinPartitions("doc_id").drop("range")
    plain = stage(ordered.mapInArrow(tidy(_segments(tokenizer_path, end)), "part int, seq int, inside long, n long, doc_ids binary, counts binary, seen binary, ids binary"), "segments")
    counts = plain.select("seen").mapInArrow(tidy(_counted), "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = [r["id"] for r in counts.orderBy(F.desc("n"), "id").collect()]  # bounded by the vocabulary
    spark.createDataFrame(list(enumerate(ranked)), "rank int, id int").coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    ranks = np.zeros(max(ranked, default=0) + 1, np.uint32)
    ranks[ranked] = np.arange(len(ranked))
    totals = {r["part"]: r["n"] for r in plain.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each shuffle partition
    before = np.concatenate([[0], np.cumsum([totals.get(p, 0) for p in range(max(totals, default=-1) + 1)])]).astype(np.int64)
    coded = plain.drop("seen").mapInArrow(tidy(_coded(ranks, before)), "part int, seq int, start long, doc_ids binary, counts binary, control binary, data binary")
    coded.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/segments")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens long, ids binary (little-endian unsigned 32 bit)."""
    ranked = {r["rank"]: r["id"] for r in spark.read.parquet(f"{path}/ranks").collect()}  # bounded by the vocabulary
    ids = np.array([ranked[k] for k in range(len(ranked))], np.uint32)
    segments = spark.read.parquet(f"{path}/segments")
    decoded = segments.mapInArrow(tidy(_decoded(ids)), "doc_id long, start long, n_tokens long, ids binary")
    return decoded.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))
