"""Document fingerprints by I-Match with randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies between LOW and HIGH of all documents (an inverse document
frequency band; a term in fewer than two documents is out). A document is the sorted distinct set of its terms in
the lexicon; a document without any uses all its terms. Its fingerprint is the hash of that set, and the hashes of what
SEEDS times RATES fixed random sub-lexicons leave of it: sub-lexicon (r, l) holds each term with probability 2^-l, by a
hash of its own, and is the same for all documents. A hash of distinct terms is a sum of mixed term hashes, which is
the same as hashing them in sorted order.

Of a document with m terms, only sub-lexicons with 2^l from about m / 2 on say something of near copies: denser ones
keep so many terms that a changed one is nearly always among them, and much sparser ones keep none. So a fingerprint
holds SHOWN rates from l = log2(m) - 1 on (``first``), and two documents are compared on the rates that both hold. Their
likeness is, of the sub-lexicons that leave either something, the share on which they agree; with thin subsets that
is about the Jaccard likeness of the term sets. Equal sets have likeness 1; documents whose sizes are so unlike that
no rate is shared have 0; two documents without terms are alike.

Document frequencies are counted exactly over all documents in two passes: a term of the band has its share in at
least one task's documents, so the terms that reach LOW of some task's documents are candidates, and the second pass
counts only those. The lexicon's size has the bound (mean distinct terms of a document) / LOW whatever the number of
documents; candidates beyond MOST_TERMS are counted by a shuffle of all terms instead, and a lexicon beyond
MOST_TERMS is not sent to the tasks: the terms of the texts are joined with it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.ranges import cuts_of, range_of
from recordloom.llm.staging import stage
from recordloom.llm.textblocks import GOLD, U, distinct, mix, owners, slices, split_words, tidy

LOW, HIGH, MOST_TERMS = 0.0005, 0.1, 4_000_000
#: Independent chains of sub-lexicons, sparsest rate 2^-(RATES), and rates that a fingerprint holds.
SEEDS, RATES, SHOWN = 16, 24, 6


def term_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct term hashes, ascending, and where each text's begin."""
    words = split_words(texts)
    n = len(words.vocabulary)
    order = np.argsort(words.hashes(), kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    pairs = distinct(owners(words.starts) * np.int64(n + 1) + rank[words.codes])
    starts = np.searchsorted(pairs, np.arange(len(words.starts)) * np.int64(n + 1))
    return words.hashes()[order][pairs % (n + 1)] if len(pairs) else np.zeros(0, np.uint64), starts


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


@dataclass
class Prints:
    """Fingerprints of some documents: hash of all terms (0: none), first rate shown, 16-bit hashes by seed and rate (0: none left)."""

    whole: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    def __getitem__(self, at: slice | np.ndarray) -> Prints:
        return Prints(self.whole[at], self.first[at], self.parts[at])

    def after(self, other: Prints) -> Prints:
        return Prints(*(np.concatenate([x, y]) for x, y in zip((other.whole, other.first, other.parts), (self.whole, self.first, self.parts), strict=True)))

    def texts(self) -> list[str]:
        parts = self.parts.reshape(len(self.whole), -1).astype(">u2")
        return [f"{int(w):016x}{int(f):02x}{p.tobytes().hex()}" for w, f, p in zip(self.whole, self.first, parts, strict=True)]


def chains(values: np.ndarray) -> Iterator[np.ndarray]:
    """For each seed a 32-bit number of each term; sub-lexicon (seed, l) holds the terms whose number is under 2^(32 - l)."""
    for r in range(0, SEEDS, 2):
        both = mix(values ^ U(int(GOLD) * (r + 1) & 0xFFFFFFFFFFFFFFFF)).view(np.uint32)
        yield from (both[0::2], both[1::2])


def printed(values: np.ndarray, of: np.ndarray, n: int) -> Prints:
    """The fingerprints of ``n`` documents from their terms (hashes), document by document."""
    out = Prints(np.zeros(n, np.uint64), np.zeros(n, np.uint8), np.zeros((n, SEEDS, SHOWN), np.uint16))
    if not len(values):
        return out
    begins = np.flatnonzero(np.diff(of, prepend=-1))
    counts = np.diff(np.append(begins, len(of)))
    own = mix(values + GOLD)
    out.whole[of[begins]] = mix(np.add.reduceat(own, begins)) | U(1)
    first = np.zeros(n, np.uint8)
    first[of[begins]] = np.clip(np.log2(counts).astype(np.int64) - 1, 1, RATES - SHOWN + 1)
    out.first[:] = first
    under = np.repeat(np.uint32(1) << (np.uint32(32) - first[of[begins]].astype(np.uint32)), counts)
    for seed, number in enumerate(chains(values)):
        at = np.flatnonzero(number < under)
        number, limit, doc, some = number[at], under[at], of[at], own[at]
        for rate in range(SHOWN):
            if not len(doc):
                break
            heads = np.flatnonzero(np.diff(doc, prepend=-1))
            out.parts[doc[heads], seed, rate] = (mix(np.add.reduceat(some, heads)) >> U(48)).astype(np.uint16) | np.uint16(1)
            limit = limit >> np.uint32(1)
            left = number < limit
            number, limit, doc, some = number[left], limit[left], doc[left], some[left]
    return out


def fingerprints(texts: pa.Array, lexicon: np.ndarray) -> Prints:
    values, starts = term_sets(texts)
    of = owners(starts)
    known = within(values, lexicon)
    some = np.zeros(len(starts) - 1, bool)
    some[of[known]] = True
    kept = known | ~some[of]
    return printed(values[kept], of[kept], len(starts) - 1)


def likeness(a: Prints, b: Prints) -> np.ndarray:
    """The share of shown sub-lexicons on which rows agree, of those that leave either something."""
    agree, either = np.zeros(len(a.whole), np.int64), np.zeros(len(a.whole), np.int64)
    shift = b.first.astype(np.int64) - a.first
    for d in range(1 - SHOWN, SHOWN):
        rows = np.flatnonzero(shift == d)
        x, y = a.parts[rows][:, :, max(d, 0) : SHOWN + min(d, 0)], b.parts[rows][:, :, max(-d, 0) : SHOWN + min(-d, 0)]
        agree[rows], either[rows] = ((x == y) & (x > 0)).sum(axis=(1, 2)), ((x > 0) | (y > 0)).sum(axis=(1, 2))
    return np.where(a.whole == b.whole, 1.0, agree / np.maximum(either, 1))


def _local(batches: Iterator[pa.RecordBatch], only: np.ndarray | None, share: float | None) -> Iterator[pa.RecordBatch]:
    """(term, df) of a task's documents: of all terms that reach ``share`` of them, or of the terms in ``only``."""
    terms, counts, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
    for batch in batches:
        for part in slices(batch, size=4_000_000):
            values, starts = term_sets(part["text"])
            n += len(starts) - 1
            if only is not None:
                values = values[within(values, only)]
            new, df = np.unique(values, return_counts=True)
            both = np.concatenate([terms, new])
            terms, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, weights=np.concatenate([counts, df]), minlength=len(terms)).astype(np.int64)
    kept = counts >= np.ceil((share or 0) * n)
    yield pa.RecordBatch.from_arrays([pa.array(terms[kept].view(np.int64)), pa.array(counts[kept])], ["term", "df"])


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): hashes of the terms whose document frequency is within the band, over all rows of ``docs``."""
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = docs.count()
    schema = "term long, df long"
    found = texts.mapInArrow(tidy(lambda b: _local(b, None, low)), schema)
    candidates = found.select("term").distinct().limit(MOST_TERMS + 1).toPandas()["term"].to_numpy(np.int64)
    if len(candidates) > MOST_TERMS:
        counted = texts.mapInArrow(tidy(lambda b: _local(b, None, None)), schema)
    else:
        only = np.sort(candidates.view(np.uint64))
        counted = texts.mapInArrow(tidy(lambda b: _local(b, only, None)), schema)
    summed = counted.groupBy("term").agg(F.sum("df").alias("df"))
    return summed.filter((F.col("df") >= max(2, low * total)) & (F.col("df") <= max(2, high * total))).select("term")


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray | DataFrame:
    """The sorted hashes of the band's terms, or their table if there are more than MOST_TERMS."""
    terms = stage(band(docs, low, high), "lexicon")
    if terms.count() > MOST_TERMS:
        return terms
    return np.sort(terms.toPandas()["term"].to_numpy(np.int64).view(np.uint64))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, term): the distinct terms of each text; (row, null) for a text without any."""
    for whole in batches:
        for batch in slices(whole):
            values, starts = term_sets(batch["text"])
            of, blank = owners(starts), np.flatnonzero(np.diff(starts) == 0)
            yield pa.RecordBatch.from_arrays([batch["row"].take(pa.array(np.append(of, blank))), pa.array(np.append(values.view(np.int64), np.zeros(len(blank), np.int64)), mask=np.arange(len(of) + len(blank)) >= len(of))], ["row", "term"])


def _of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, whole, first, parts) from (row, terms sorted)."""
    for batch in batches:
        lists = batch["terms"]
        starts = lists.offsets.to_numpy().astype(np.int64)
        prints = printed(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), owners(starts - starts[0]), batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch["row"], pa.array(prints.whole.view(np.int64)), pa.array(prints.first.astype(np.int32)), pa.array([p.tobytes() for p in prints.parts], pa.binary())], ["row", "whole", "first", "parts"])


def by_join(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, whole, first, parts) of rows (row, text) for a lexicon that is a table."""
    own = rows.mapInArrow(tidy(_terms), "row long, term long")
    known = own.join(terms.withColumn("known", F.lit(True)), "term", "left")
    lists = known.groupBy("row").agg(F.collect_list(F.when(F.col("known"), F.col("term"))).alias("in"), F.collect_list("term").alias("all"))
    return lists.select("row", F.when(F.size("in") > 0, F.col("in")).otherwise(F.col("all")).alias("terms")).mapInArrow(tidy(_of_terms), "row long, whole long, first int, parts binary")


def _prints(batch: pa.RecordBatch, prefix: str) -> Prints:
    parts = np.frombuffer(b"".join(batch[f"{prefix}parts"].to_pylist()), np.uint16).reshape(-1, SEEDS, SHOWN)
    return Prints(batch[f"{prefix}whole"].to_numpy().view(np.uint64), batch[f"{prefix}first"].to_numpy().astype(np.uint8), parts)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(doc_ids, texts, edited texts) in slices; the last id and text of each are of the next slice's first document."""
    last, helped = None, False
    for whole in batches:
        for batch in slices(whole, size=4_000_000):
            own = batch.num_rows - sum(batch["extra"].to_pylist())
            batch = batch.slice(0, own + (own < batch.num_rows and not helped))  # of rows that repeat the head's id, one
            helped = helped or own < batch.num_rows
            ids, texts = batch["doc_id"].to_pylist(), batch["text"].to_pylist()
            if not ids:
                continue
            if last is not None:
                ids, texts = [last[0], *ids], [last[1], *texts]
            last = (ids[-1], texts[-1])
            if len(ids) > 1:
                yield ids, texts, [t[: len(t) - len(t) // 3] + after[: len(t) // 3] for t, after in zip(texts, texts[1:], strict=False)]


def _finished(ids: list, sizes: list, hashes: list, prints: Prints, new: Prints, after: Prints) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(ids, pa.int64()), "n_chars": pa.array(sizes, pa.int64()), "edited_sha256": pa.array(hashes, pa.string()),
        "fingerprint": pa.array(prints.texts(), pa.string()), "edited_fingerprint": pa.array(new.texts(), pa.string()), "near_edited": pa.array(likeness(prints, new)), "near_next": pa.array(likeness(prints, after)),
    })


def _sha256(texts: list[str]) -> list[str]:
    return [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def _edited(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for ids, texts, edited in _edits(batches):
            prints = fingerprints(pa.array(texts if last is None else texts[1:], pa.string()), table)
            prints = prints if last is None else prints.after(last)
            last = prints[len(ids) - 1 :]
            new = fingerprints(pa.array(edited, pa.string()), table)
            yield _finished(ids[:-1], [len(t) for t in texts[:-1]], _sha256(edited), prints[: len(ids) - 1], new, prints[1:])

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, after, doc_id, n_chars, edited_sha256, text, edited); the last text of a task has no doc_id."""
    part, row = TaskContext.get().partitionId() << 40, 0
    for ids, texts, edited in _edits(batches):
        n = len(edited)
        numbers = part + row + np.arange(n + 1)
        yield pa.RecordBatch.from_pydict({"row": pa.array(numbers[:-1]), "after": pa.array(numbers[1:]), "doc_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()), "edited_sha256": pa.array(_sha256(edited)), "text": pa.array(texts[:-1], pa.string()), "edited": pa.array(edited, pa.string()), "next": pa.array(texts[1:], pa.string())})
        row += n


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _finished(batch["doc_id"].to_pylist(), batch["n_chars"].to_pylist(), batch["edited_sha256"].to_pylist(), *(_prints(batch, f"{p}_") for p in ("text", "edited", "next")))


def _printed(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, size=4_000_000):
                yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fingerprints(batch["text"], table).texts(), pa.string())], ["doc_id", "fingerprint"])

    return run


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of every row. Null texts are empty (a fingerprint of zeros); repeated rows give a row each, an
    empty table none; very long texts are read whole; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    table = lexicon(docs)
    if isinstance(table, DataFrame):
        numbered = stage(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
        prints = by_join(numbered.select("row", "text"), table)
        return numbered.select("row", "doc_id").join(prints, "row").mapInArrow(tidy(_shown), "doc_id long, fingerprint string")
    return rows.mapInArrow(tidy(_printed(table)), "doc_id long, fingerprint string")


def _shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(_prints(batch, "").texts(), pa.string())], ["doc_id", "fingerprint"])


def fingerprints_and_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edit: its last third replaced by the beginning of the next document.

    The next document is the one with the next lower doc_id, after the last the first. Rows with a null doc_id come after
    all others in this order; rows that repeat a doc_id follow each other in the order of their texts' hashes; null
    texts are empty; very long texts are read whole; an empty table gives no rows; other columns are ignored. Documents are dealt out by ranges of doc_id; the
    first document of each range goes to the range before it too, so every neighbour is at hand.
    """
    table = lexicon(docs)
    ordered = _ordered(docs)
    if isinstance(table, DataFrame):
        apart = stage(ordered.mapInArrow(tidy(_apart), "row long, after long, doc_id long, n_chars long, edited_sha256 string, text string, edited string, next string"), "edits")
        out = apart.select("row", "doc_id", "n_chars", "edited_sha256")
        for name in ("text", "edited", "next"):
            prints = by_join(apart.select("row", F.col(name).alias("text")), table)
            out = out.join(prints.select("row", *[F.col(c).alias(f"{name}_{c}") for c in ("whole", "first", "parts")]), "row")
        out = out.mapInArrow(tidy(_joined), EDITED)
    else:
        out = ordered.mapInArrow(tidy(_edited(table)), EDITED)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


#: Stands for a null doc_id, below all others.
NO_ID = -(2**63)


def _ordered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, extra): the documents in descending order by range, and after each range its neighbour (extra = 1)."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = rows.select("doc_id")
    cuts = cuts_of(ids, "doc_id", n)
    part = F.lit(len(cuts)) - range_of("doc_id", cuts)
    heads = {r["part"]: r["head"] for r in ids.select(part.alias("part"), "doc_id").groupBy("part").agg(F.max("doc_id").alias("head")).collect()}  # a row for each range
    used = sorted(heads)
    schema = "after long, goes int"
    after = docs.sparkSession.createDataFrame([(heads[used[(k + 1) % len(used)]], p) for k, p in enumerate(used)], schema)
    extra = rows.join(F.broadcast(after), rows.doc_id == after.after).select("doc_id", "text", F.col("goes").alias("part"), F.lit(1).alias("extra"))
    dealt = rows.withColumn("part", part).withColumn("extra", F.lit(0)).unionByName(extra)
    ordered = dealt.repartitionById(max(len(cuts) + 1, 1), "part").sortWithinPartitions("extra", F.desc("doc_id"), F.xxhash64("text"))
    return ordered.select("doc_id", "text", "extra")
