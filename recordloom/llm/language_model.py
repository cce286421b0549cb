"""Language-model scoring by deleted interpolation of n-grams.

The model mixes maximum-likelihood estimates, P(w | u v) = w0 / (V + 1) + w1 c(w) / N + w2 c(v w) / c(v) + w3 c(u v w) / c(u v),
with V distinct tokens (words and the end) and N tokens in training, u and v the tokens before. Before the first word
stands the end of another document, so its context is counted by the ends, and its trigram is its bigram. The weights
depend on the frequency of the longest context that was seen, in buckets: powers of two for u v, else powers of four
for v. They are learned by expectation-maximisation on held-out counts: documents of training whose crc32 modulo 7 is
FOLD, each with its own counts deleted. The score deletes a training document's own counts as well, so that training
and held-out documents are scored alike: what a document says itself is no evidence for it, what a copy elsewhere says is.

Counts never leave the cluster's shuffle and no table of n-grams is broadcast. Documents are kept in blocks of
BLOCK_BYTES of text. A block sends the sorted distinct n-gram keys of its documents with their counts to the owners of
key ranges, as delta-coded bytes; an owner adds up the counts of all blocks and answers each block with the totals of
just the n-grams it asked for, in its order. A block with its answers scores its documents without any further join.
There are as many ranges as keep a range's share of all blocks to a few megabytes, whatever the input. Bytes sent follow
the number of distinct n-grams of each block, so the input.

The joint distribution of (bucket, unigram, bigram and trigram estimates) over held-out tokens is summed on a grid of half
octaves, whose size has a bound whatever the input; the expectation-maximisation runs on that histogram.

Keys are the leading bits of 64-bit hashes, 20 more than the input's bytes have, so that one n-gram in a million or
fewer shares its key with another; the last bit kept tells words from longer n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.packs import cut_at, grown, packed, small, unpacked
from recordloom.llm.staging import buckets, stage_by
from recordloom.llm.textblocks import POLY, U, mix, slices, split_words, tidy

HELD_OUT, FOLD, MODULUS = 2, 0, 7
#: Bytes of text in a block, ranges of keys for each block, buckets of either context's frequency, and of all.
BLOCK_BYTES, RANGES_A_BLOCK, EACH = 5_000_000, 1.25, 8
BUCKETS = 1 + 2 * EACH
END = U(0x9D8C1F3A5B7E6420)
#: Half octaves kept for an estimate: 1 to 2^-32, and one for zero.
GRID = 2 * 32 + 1


def remainders(ids: list) -> np.ndarray:
    """crc32 of the id as text, modulo 7; a null id counts as empty text."""
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % MODULUS for i in ids], np.int64)


def key_bits(blocks: int) -> int:
    return min(64, 20 + (max(blocks, 1) * BLOCK_BYTES).bit_length())


class Block:
    """The n-grams of a block's documents: distinct sorted keys, and where each token's unigram, bigram and trigram and
    their contexts are."""

    def __init__(self, ids: list, texts: pa.Array, bits: int):
        words = split_words(texts)
        n_docs = len(words.starts) - 1
        one = np.insert(words.hashes()[words.codes], words.starts[1:], END)
        self.starts = words.starts + np.arange(n_docs + 1)
        first, last = self.starts[:-1], self.starts[1:] - 1
        before = np.concatenate([one[:1], one[:-1]])
        before[first] = END
        two = mix(before * POLY + one)
        three = mix(np.concatenate([before[:1], before[:-1]]) * POLY + two)
        three[first] = two[first]
        cut = U(64 - bits)
        kept = lambda x, flag: (x >> cut | U(1)) ^ U(1 - flag)
        keys = np.concatenate([kept(mix(one + U(1)), 1), kept(two, 0), kept(three, 0)]) << cut
        self.n, self.fold = len(one), remainders(ids)
        self.grams, place = np.unique(keys, return_inverse=True)
        self.uni, self.bi, self.tri = place[: self.n], place[self.n : 2 * self.n], place[2 * self.n :]
        back = lambda x: np.concatenate([x[:1], x[:-1]])
        self.ctx, self.ctx2 = back(self.uni), back(self.bi)
        self.ctx[first] = self.ctx2[first] = self.uni[last]
        self.doc = np.repeat(np.arange(n_docs), np.diff(self.starts))
        self.cut = cut

    def train(self) -> np.ndarray:
        use = self.fold[self.doc] != HELD_OUT
        rest = use.copy()
        rest[self.starts[:-1]] = False  # a first token's trigram is its bigram
        return np.bincount(np.concatenate([self.uni[use], self.bi[use], self.tri[rest]]), minlength=len(self.grams))

    def own(self, use: np.ndarray) -> list[np.ndarray]:
        """How often each token's unigram, bigram, trigram and contexts (v; u v) are in its document; 0 outside ``use``."""
        at, n = np.flatnonzero(use), len(self.starts) - 1
        held = np.concatenate([self.uni[at], self.bi[at], self.tri[at] + len(self.grams)])  # a first token's trigram is no bigram
        _, place, counts = np.unique(held * n + np.tile(self.doc[at], 3), return_inverse=True, return_counts=True)
        uni, bi, tri = (np.zeros(self.n, np.int64) for _ in range(3))
        uni[at], bi[at], tri[at] = np.split(counts[place], 3)
        first, last = self.starts[:-1], self.starts[1:] - 1
        tri[first] = bi[first]
        ctx, ctx2 = (np.concatenate([x[:1], x[:-1]]) for x in (uni, bi))
        ctx[first] = ctx2[first] = uni[last]
        return [uni, bi, tri, ctx, ctx2]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, ids, texts): the documents of a task in runs of about BLOCK_BYTES."""
    part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0

    def row() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        ids, texts = table["doc_id"].combine_chunks(), table["text"].combine_chunks()
        one = lambda a, kind: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a.cast(kind))
        return pa.RecordBatch.from_arrays([pa.array([part << 32 | seq]), one(ids, pa.int64()), one(texts, pa.string())], ["block", "ids", "texts"])

    for whole in batches:
        for batch in slices(whole, size=max(1, BLOCK_BYTES // 10)):
            held.append(batch)
            size += int(pc.sum(pc.binary_length(batch["text"])).as_py() or 0) + 64 * batch.num_rows
            if size >= BLOCK_BYTES:
                yield row()
                seq, held, size = seq + 1, [], 0
    if held:
        yield row()


ASKED = {"owner": pa.int32(), "block": pa.int64(), "grams": pa.binary(), "train": pa.binary()}


def _asked(owners: int, bits: int):
    """Rows (owner, block, grams, train) of each block for each owner of a key range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b = Block(batch["ids"][k].values.to_pylist(), batch["texts"][k].values, bits)
                train, cuts, block = b.train(), cut_at(b.grams, owners), batch["block"][k].as_py()
                rows = [(o, block, packed(b.grams[x:y] >> b.cut), small(train[x:y])) for o, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if y > x]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ASKED.values(), strict=True)], list(ASKED))

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each owner: add up all blocks' counts and answer each block. Rows come sorted by owner."""
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        grams = [unpacked(r[2]) for r in held]
        keys, place = np.unique(np.concatenate(grams), return_inverse=True)
        train = np.bincount(place, weights=np.concatenate([grown(r[3]) for r in held]), minlength=len(keys)).astype(np.int64)
        word = (keys & U(1)).astype(bool)
        facts = (int((word & (train > 0)).sum()), int(train[word].sum()))
        cuts = np.cumsum([0, *map(len, grams)])
        out = [(r[1], r[0], small(train[place[a:b]]), *(facts if k == 0 else (0, 0))) for k, (r, a, b) in enumerate(zip(held, cuts[:-1], cuts[1:], strict=True))]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "owner", "train", "v", "n"])

    for batch in batches:
        for r in zip(*(batch[c].to_pylist() for c in ASKED), strict=True):
            if held and held[0][0] != r[0]:
                yield from flush()
                held = []
            held.append(r)
    if held:
        yield from flush()


def bucket(pairs: np.ndarray, words: np.ndarray) -> np.ndarray:
    """0 if neither context was seen, 1 + log4 of the frequency of v, or EACH + 1 + log2 of that of u v if it was."""
    log2 = lambda x: np.log2(np.maximum(x, 1)).astype(np.int64)
    shorter = np.where(words > 0, 1 + np.minimum(log2(words) // 2, EACH - 1), 0)
    return np.where(pairs > 0, 1 + EACH + np.minimum(log2(pairs), EACH - 1), shorter)


def grid(p: np.ndarray) -> np.ndarray:
    return np.where(p > 0, np.clip((-2 * np.log2(np.maximum(p, 1e-300))).astype(np.int64), 0, GRID - 2), GRID - 1)


def estimates(b: Block, train: np.ndarray, docs: np.ndarray, tokens: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bucket, [unigram, bigram, trigram estimate]) of the tokens of the chosen documents, without their own counts."""
    use = docs[b.doc]
    own = b.own(use & (b.fold != HELD_OUT)[b.doc])
    uni, bi, tri, ctx, ctx2 = (train[place[use]] - mine[use] for place, mine in zip((b.uni, b.bi, b.tri, b.ctx, b.ctx2), own, strict=True))
    size = np.where(b.fold == HELD_OUT, 0, np.diff(b.starts))
    left = np.maximum(tokens - size[b.doc[use]], 1)
    return bucket(ctx2, ctx), [uni / left, bi / np.maximum(ctx, 1), tri / np.maximum(ctx2, 1)]


def _with_answers(row: dict, bits: int) -> tuple[Block, np.ndarray]:
    b = Block(row["ids"].values.to_pylist(), row["texts"].values, bits)
    parts = sorted(zip(row["owners"].as_py(), row["train"].as_py(), strict=True))
    return b, np.concatenate([grown(p) for _, p in parts])


def _histogram(bits: int, tokens: int):
    """Rows (cell, n): the tokens of fold FOLD by bucket and estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(BUCKETS * GRID**3, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                b, train = _with_answers({c: batch[c][k] for c in batch.schema.names}, bits)
                of, parts = estimates(b, train, b.fold == FOLD, tokens)
                for p in parts:
                    of = of * GRID + grid(p)
                cells += np.bincount(of, minlength=len(cells))
        seen = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(cells[seen])], ["cell", "n"])

    return run


def learned(cell: np.ndarray, n: np.ndarray, vocabulary: int, rounds: int = 60) -> np.ndarray:
    """The weights (bucket, [uniform, unigram, bigram, trigram]) by expectation-maximisation on the histogram."""
    of = cell // GRID**3
    value = lambda g: np.where(g == GRID - 1, 0.0, 2.0 ** (-(g + 0.5) / 2))
    parts = np.stack([np.full(len(cell), 1 / (vocabulary + 1)), *(value(cell // GRID**k % GRID) for k in (2, 1, 0))], axis=1)
    allowed = np.ones((BUCKETS, 4))
    allowed[0, 2:] = 0
    allowed[: EACH + 1, 3] = 0
    weights = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        share = weights[of] * parts
        share *= (n / share.sum(axis=1))[:, None]
        total = np.stack([np.bincount(of, weights=share[:, j], minlength=BUCKETS) for j in range(4)], axis=1)
        total += 1e-3 * allowed  # every word keeps a probability
        weights = total / total.sum(axis=1, keepdims=True)
    return weights


def _scores(weights: np.ndarray, vocabulary: int, tokens: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                b, train = _with_answers({c: batch[c][k] for c in batch.schema.names}, bits)
                of, parts = estimates(b, train, np.ones(len(b.fold), bool), tokens)
                w, uni = weights[of], train[b.uni]
                p = w[:, 0] / (vocabulary + 1) + w[:, 1] * parts[0] + w[:, 2] * parts[1] + w[:, 3] * parts[2]
                base = np.log10((uni + 1) / (tokens + vocabulary + 1))
                by_doc = lambda x: np.add.reduceat(x, b.starts[:-1])  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch["ids"][k].values, pa.array(b.fold == HELD_OUT), pa.array(np.diff(b.starts)), pa.array(by_doc((uni > 0).astype(np.int64))), pa.array(np.full(len(b.fold), tokens, np.int64)), pa.array(by_doc(base)), pa.array(by_doc(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    base_score is the add-one unigram score, score the interpolated model's log10 probability of the text with its
    end, without the document's own counts. Training rows are those whose crc32 of the id as text, modulo 7, is not 2.
    Null texts are empty and have the end only; very long texts are scored whole, in a block of their own; repeated rows
    count and are scored each, so ties score alike; an empty table gives no rows; other columns are ignored. With no
    training rows every estimate is the uniform one.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = stage_by(rows.mapInArrow(tidy(_blocks), "block long, ids array<long>, texts array<string>"), "blocks", "block")
    n, n_blocks = int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.count()
    owners, bits = max(n, int(n_blocks * RANGES_A_BLOCK)), key_bits(n_blocks)
    asked = blocks.mapInArrow(tidy(_asked(owners, bits)), "owner int, block long, grams binary, train binary")
    answers = asked.repartitionById(owners, "owner").sortWithinPartitions("owner").mapInArrow(tidy(_answered), "block long, owner int, train binary, v long, n long")
    answers = stage_by(answers.repartition(buckets(spark), "block"), "answers", "block")  # a file for each bucket
    facts = answers.agg(F.sum("v"), F.sum("n")).first()
    vocabulary, tokens = (int(x or 0) for x in facts)
    per_block = answers.groupBy("block").agg(F.collect_list(F.struct("owner", "train")).alias("a")).select("block", F.col("a.owner").alias("owners"), F.col("a.train").alias("train"))
    joined = blocks.join(per_block.hint("merge"), "block").drop("block")  # both tables are bucketed: nothing moves
    cells = joined.mapInArrow(tidy(_histogram(bits, tokens)), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    weights = learned(cells["cell"].to_numpy(np.int64), cells["n"].to_numpy(np.float64), vocabulary) if len(cells) else np.tile([1.0, 0.0, 0.0, 0.0], (BUCKETS, 1))
    return joined.mapInArrow(tidy(_scores(weights, vocabulary, tokens, bits)), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
