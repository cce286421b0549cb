"""Compact binary forms in which tasks send each other vectors and batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def _planes(values: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _values(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    raw = pa.Codec("zstd").decompress(data[8:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).view(kind).ravel()


def packed(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit values as byte planes of their differences, compressed."""
    return _planes(np.diff(values, prepend=np.uint64(0))) if len(values) else b""


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    return np.cumsum(_values(data, np.uint64), dtype=np.uint64)


def small(values: np.ndarray) -> bytes:
    """Unsigned 32-bit values as byte planes, compressed."""
    return _planes(values.astype(np.uint32)) if len(values) else b""


def grown(data: bytes) -> np.ndarray:
    return _values(data, np.uint32).astype(np.int64) if data else np.zeros(0, np.int64)


def sealed(batch: pa.RecordBatch) -> bytes:
    """A whole batch as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def cut_at(keys: np.ndarray, parts: int) -> list[int]:
    """Where ascending 64-bit keys cut into ``parts`` equal ranges of the key space (parts + 1 bounds)."""
    edges = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
