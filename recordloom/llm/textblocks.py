"""Vectorised word work on Arrow batches: splitting, hashing, grouping of values by document.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. All functions take whole texts; a null text is empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

U = np.uint64
#: Odd multipliers of the splitmix64 finaliser and of the polynomial that joins words.
M1, M2, GOLD, POLY = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit values."""
    x = x ^ (x >> U(30))
    x *= M1
    x ^= x >> U(27)
    x *= M2
    x ^= x >> U(31)
    return x


@dataclass
class Words:
    vocabulary: pa.Array  #: distinct words
    codes: np.ndarray  #: index into vocabulary for each word, in text order
    starts: np.ndarray  #: of document i, the words [starts[i], starts[i + 1])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each vocabulary entry."""
        if not len(self.vocabulary):
            return np.zeros(0, np.uint64)
        return hash_array(self.vocabulary.to_numpy(zero_copy_only=False), categorize=False)


def split_words(texts: pa.Array, lower: bool = True) -> Words:
    """Words of each text, as codes into the batch's vocabulary."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    starts, values = lists.offsets.to_numpy().astype(np.int64), lists.values
    full = pc.greater(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        values = values.filter(pa.array(full))
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
    coded = values.dictionary_encode()
    return Words(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), starts)


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The sum of each run [starts[i], starts[i + 1]); 0 for empty runs. Unsigned values wrap."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[starts[1:]] - total[starts[:-1]]


def owners(starts: np.ndarray) -> np.ndarray:
    """The document of each value."""
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending (by sorting, which is faster than hashing for whole batches)."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about ``size`` bytes of text (one row at least), so working memory is bounded."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def release() -> None:
    """Give freed memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """``run`` for mapInArrow, giving what it used back to the system when a task ends (workers outlive their tasks)."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
