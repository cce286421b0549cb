"""Benchmark decontamination by the q-gram lemma on diagonal bands, with verification by banded alignment.

Texts and items are compared lower-cased, with each run of white space as one space. An item is cut into overlapping
windows of WINDOW characters (a shorter item is one window). A window within k edits of a region shares at least
``length - q + 1 - k q`` q-grams with it, and all of them lie on k + 1 neighbouring diagonals (text position minus
item position). Shared q-grams are counted in diagonal bands of width 2 (k + 1) that overlap by half, so every such
region lies whole in one band; bands under the bound are left out, and the others are verified by an edit-distance
programme limited to the band. A document holds an item if verified windows cover at least half of it, or STRETCH
characters of it without a gap.

Common q-grams are left out exactly: if b of a window's n q-grams must be shared, then of its n - b + t rarest at least t
must be, so only those are looked up and t = LEAST (or b, if less) is the bound. Occurrences are counted in slices of
bounded size that overlap by the reach of a region, so one long text doesn't cost more memory than many short ones.

Items go to the tasks in blocks of at most BLOCK_CHARS characters; more items take more passes over the documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.textblocks import U, slices, tidy

Q, WINDOW, STEP, EDITS, COVER = 6, 64, 32, 0.125, 0.5
#: Characters (about 50 words) of an item in one verified stretch that are a hit whatever the item's length.
STRETCH = 300
BLOCK_CHARS = 8_000_000
#: Shared q-grams asked of a window's rarest, and occurrences that are counted at once.
LEAST, SLICE = 8, 4_000_000
CODE = np.uint64(0x100000001B3)


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def grams(points: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the q-gram at each position (Q - 1 fewer than code points)."""
    if len(points) < Q:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    wide *= np.uint64(0x9E3779B97F4A7C15)
    n = len(points) - Q + 1
    h = wide[:n].copy()
    for k in range(1, Q):
        h *= CODE
        h ^= h >> np.uint64(29)
        h += wide[k : k + n]
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Items:
    """The windows of a block of items, and where the grams that a match can't all miss occur."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = np.array([i for i, _ in items], np.int64)
        self.points = [points_of(normal(t)) for _, t in items]
        item, start, length = [], [], []
        for k, p in enumerate(self.points):
            m = len(p)
            if m >= Q:
                begins = [0] if m <= WINDOW else sorted({*range(0, m - WINDOW, STEP), m - WINDOW})
                item += [k] * len(begins)
                start += begins
                length += [min(m, WINDOW)] * len(begins)
        self.item, self.start, self.length = (np.array(x, np.int64) for x in (item, start, length))
        self.edits = (self.length * EDITS).astype(np.int64)
        self.half = (self.edits + 1).astype(np.int32)
        whole = self.length - Q + 1
        least = np.maximum(whole - self.edits * Q, 1)
        parts = [grams(self.points[k][a : a + n]) for k, a, n in zip(item, start, length, strict=True)]
        g = np.concatenate([np.zeros(0, np.uint64), *parts])
        window = np.repeat(np.arange(len(item)), whole)
        offset = np.arange(len(g)) - np.repeat(np.cumsum(whole) - whole, whole)
        every, place, often = np.unique(g, return_inverse=True, return_counts=True)
        self.least = np.minimum(least, LEAST)
        order = np.lexsort((offset, often[place], window))  # each window's grams, rare ones first
        nth = np.empty(len(g), np.int64)
        nth[order] = offset  # as many places in the window's run as it has grams
        rare = nth < (whole - least + self.least)[window]
        place, window, offset = place[rare], window[rare], offset[rare]
        order = np.argsort(place, kind="stable")
        self.window, self.offset = window[order].astype(np.int32), offset[order].astype(np.int32)
        used, self.counts = np.unique(place, return_counts=True)
        self.keys, self.first = every[used], np.cumsum(self.counts) - self.counts
        self.bits = min(max(len(self.keys).bit_length() + 6, 12), 24)
        self.slots = np.full(1 << self.bits, -1, np.int32)  # the first key of those with the same leading bits
        self.slots[(self.keys >> U(64 - self.bits))[::-1]] = np.arange(len(self.keys) - 1, -1, -1)
        self.reach = int((self.length + 2 * self.half).max(initial=1))

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the hashes that are keys, the key of each)."""
        key = self.slots[hashes >> U(64 - self.bits)]
        at = np.flatnonzero(key >= 0)
        key, own = key[at], hashes[at]
        wrong = np.flatnonzero(self.keys[key] != own)
        while len(wrong):  # keys with the same leading bits stand side by side
            key[wrong] += 1
            key[wrong[key[wrong] == len(self.keys)]] = -1
            on = key[wrong] >= 0
            on[on] = (self.keys[key[wrong[on]]] >> U(64 - self.bits)) == (own[wrong[on]] >> U(64 - self.bits))
            key[wrong[~on]] = -1
            wrong = wrong[on]
            wrong = wrong[self.keys[key[wrong]] != own[wrong]]
        is_key = key >= 0
        return at[is_key], key[is_key]


def banded(text: np.ndarray, begin: np.ndarray, end: np.ndarray, low: np.ndarray, width: int, windows: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """The least edits that turn window i into a region of text[begin[i] : end[i]] whose diagonals lie in
    [low[i], low[i] + width); ``most`` + 1 if they are more than ``most``. Rows that got there are dropped on the way."""
    cells = np.arange(width, dtype=np.int32)
    out = np.full(len(low), most + 1, np.int32)
    left, row = np.arange(len(low)), np.zeros((len(low), width), np.int32)
    first = (begin + low)[:, None] + cells
    for r in range(windows.shape[1]):
        at = first + r
        same = (text[np.minimum(np.maximum(at, 0), len(text) - 1)] == windows[left, r][:, None]) & (at >= begin[left, None]) & (at < end[left, None])
        new = row + ~same
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new -= cells
        row = np.minimum.accumulate(new, axis=1) + cells
        if r % 4 == 3 or r + 1 == windows.shape[1] or (sizes[left] == r + 1).any():
            least = row.min(axis=1)
            ends = sizes[left] == r + 1
            out[left[ends]] = np.minimum(least[ends], most + 1)
            on = ~ends & (least <= most)
            left, row, first = left[on], row[on], first[on]
            if not len(left):
                break
    return out


def candidates(at: np.ndarray, key: np.ndarray, begins: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, window, band) of the bands with enough of the window's grams; band b covers diagonals from b * half on."""
    none = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(none, none, none)]
    doc = np.searchsorted(begins, at, "right") - 1
    place = (at - begins[doc] + WINDOW).astype(np.int32)  # diagonals reach below the text's begin
    bands = int(place.max(initial=0)) + 3
    upto = np.cumsum(items.counts[key])
    a = 0
    while a < len(at):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE)))
        back = int(np.searchsorted(at, at[a] - items.reach))  # a region that reaches over the cut is whole in the next slice
        k, c = key[back:b], items.counts[key[back:b]]
        index = np.repeat(items.first[k] - (np.cumsum(c) - c), c) + np.arange(c.sum())
        window = items.window[index]
        band = (np.repeat(place[back:b], c) - items.offset[index]) // items.half[window] + 1
        cell = (np.repeat(doc[back:b], c) * np.int64(len(items.item)) + window) * bands + band
        # a gram lies in bands band - 1 and band, each of width 2 * half; repeats of a gram can only add candidates
        size = 1 << max(12, min(len(cell).bit_length(), 22))
        slot = cell & (size - 1)  # slots may be shared, so a band with enough is never missed
        tally = np.bincount(slot, minlength=size + 1)
        tally[size] = tally[0]
        enough = tally[:-1] + tally[1:] >= items.least.min()
        enough |= np.roll(enough, 1)
        cells, one = np.unique(cell[enough[slot]], return_counts=True)
        if len(cells):
            below = np.searchsorted(cells, cells + 1)
            below[below == len(cells)] = 0
            both = one + np.where(cells[below] == cells + 1, one[below], 0)
            above = np.searchsorted(cells, cells - 1)
            alone = np.where(cells[np.minimum(above, len(cells) - 1)] == cells - 1, 0, one)
            for some, shared in ((cells, both), (cells - 1, alone)):
                w = some // bands % len(items.item)
                ok = shared >= items.least[w]
                found.append((some[ok] // bands // len(items.item), w[ok], some[ok] % bands - 1))
        a = b
    rows = np.unique(np.stack([np.concatenate(c) for c in zip(*found, strict=True)], axis=1), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 2]


def search(texts: list[str], items: Items) -> list[tuple[int, int, int, int, int, int]]:
    """(text number, item number, covered, length of item, start, edits) of every item held by a text."""
    if not len(items.item):
        return []
    cleaned = [normal(t) for t in texts]
    lengths = np.array([len(t) for t in cleaned], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    points = points_of("\0".join(cleaned) + "\0")
    doc, window, band = candidates(*items.found(grams(points)), begins, items)
    held: dict[tuple[int, int], list] = {}
    for edits in np.unique(items.edits[window]).tolist():
        own = np.flatnonzero(items.edits[window] == edits)
        for part in range(0, len(own), 4096):
            k = own[part : part + 4096]
            d, w, low = doc[k], window[k], band[k] * (edits + 1) - WINDOW
            sizes = items.length[w]
            windows = np.zeros((len(w), int(sizes.max())), np.uint32)
            for r, one in enumerate(w.tolist()):
                windows[r, : sizes[r]] = items.points[items.item[one]][items.start[one] : items.start[one] + sizes[r]]
            cost = banded(points, begins[d], begins[d] + lengths[d], low, 2 * (edits + 1), windows, sizes, edits)
            for j in np.flatnonzero(cost <= edits).tolist():
                held.setdefault((int(d[j]), int(items.item[w[j]])), []).append((int(items.start[w[j]]), int(sizes[j]), int(cost[j]), max(0, int(low[j]))))
    out = []
    for (d, item), parts in sorted(held.items()):
        covered, upto, begin, longest = 0, 0, 0, 0
        for start, length, _, _ in sorted(parts):
            begin = start if start > upto else begin
            longest = max(longest, start + length - begin)
            covered += max(0, start + length - max(start, upto))
            upto = max(upto, start + length)
        size = len(items.points[item])
        if covered >= COVER * size or longest >= STRETCH:
            out.append((d, item, covered, size, min(p[3] for p in parts), min(p[2] for p in parts)))
    return out


#: The items of the last block that this process searched for.
_kept: dict[str, Items] = {}


def _searched(block: list[tuple[int, str]]):
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _kept:
            _kept.clear()
            _kept[name] = Items(block)
        items = _kept[name]
        for whole in batches:
            for batch in slices(whole):
                rows = search(batch["text"].to_pylist(), items)
                doc, item, covered, size, start, edits = (list(c) for c in zip(*rows, strict=True)) if rows else ([],) * 6
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(pa.array(doc, pa.int64())), pa.array(items.ids[item] if item else [], pa.int64()), pa.array(covered, pa.int64()), pa.array(size, pa.int64()), pa.array(start, pa.int64()), pa.array(edits, pa.int64())],
                    ["doc_id", "item_id", "covered", "item_chars", "text_start", "edits"],
                )

    return run


def _clean(block: list[tuple[int, str]]):
    found = _searched(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                rows = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch["text"]], ["doc_id", "text"])
                left = np.ones(batch.num_rows, bool)
                for held in found(iter([rows])):
                    left[held["doc_id"].to_numpy()] = False
                yield batch.filter(pa.array(left))

    return run


def _blocks(items: DataFrame) -> list[list[tuple[int, str]]]:
    """The items in blocks of BLOCK_CHARS, one at least. They pass the driver: a benchmark is far smaller than a corpus."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null and text is not null")
    blocks, block, size = [], [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        if block and size + len(row["text"]) > BLOCK_CHARS:
            blocks.append(block)
            block, size = [], 0
        block.append((row["item_id"], row["text"]))
        size += len(row["text"])
    return [*blocks, block]


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds.

    doc_id, item_id, covered (characters of the item in verified windows), item_chars, text_start (a lower bound of
    where it begins in the normalised text), edits (of the best window): long. Null and empty texts hold nothing;
    items shorter than a q-gram or null are held by nothing; repeated rows give rows each, repeated items too; without
    documents or items there are no rows. Very long texts are searched whole, in slices of bounded size. Of windows
    that tie, the first counts for text_start. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, covered long, item_chars long, text_start long, edits long"
    return reduce(DataFrame.unionByName, [docs.mapInArrow(tidy(_searched(b)), schema) for b in _blocks(items)])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with their columns, whatever their ids; nothing is shuffled."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for block in _blocks(items):
        docs = docs.mapInArrow(tidy(_clean(block)), fields)
    return docs
