"""MinHash near-duplicates by fast similarity sketching.

A document's set holds the 64-bit hashes of its distinct five-word shingles; with fewer words the whole sequence is
one shingle; without words the set is empty and the document is linked with nothing.

The sketch (Dahlgaard, Knudsen and Thorup 2017) has T coordinates. In round i < T every element is thrown into one
bin by a hash of its own for the round; in round T + j every element goes to bin j. A bin keeps the least
(round, hash) that reached it, and a document stops after the first round that leaves no bin empty, so every
coordinate is filled after 2 T rounds at most, and in O(T log T + n) expected steps. Agreement of two sketches is an
unbiased estimate of the Jaccard similarity with Chernoff-type concentration.

Steps, each a distributed plan:

1. sketch every text in one pass; exact copies share a digest of their set and are represented by their least id;
2. cut sketches into bands; a bucket holds the representatives that agree on a whole band; the texts of those in a
   bucket of two or more are set apart once, for all confirmations;
3. link every representative with the least one that it shares a bucket with (one pair each), and confirm on full sets;
4. components by minimum-label propagation with pointer jumping;
5. twice: in buckets that still hold more than one component, compare the members outside the bucket's largest
   component with all others by their whole sketches, blocks against blocks in numpy, take the most similar one of
   each, confirm, and join components;
6. pairs of components that still hold a pair of members in one bucket which the sketches don't rule out are compared
   as wholes: the members of the smaller ones, in blocks, against the larger one's, in blocks, on full sets.

Steps 3 and 5 only save work: step 6 confirms all that they leave, so no step drops a candidate by rank or count. A
pair at exactly 0.75 meets in no bucket with probability (1 - 0.75^6)^48 < 1e-4, at 0.85 below 1e-9. The sketches rule
a pair out if their agreement is 0.13 below the threshold, five standard deviations of 288 coordinates. A large group
of exact copies costs one row after step 1, and a large group of near copies a pair or two for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.staging import stage
from recordloom.llm.textblocks import GOLD, POLY, U, Words, mix, owners, slices, split_words, sums, tidy

SHINGLE, BANDS, BAND_ROWS = 5, 48, 6
COORDINATES = BANDS * BAND_ROWS
#: Members of a star that one group confirms, and members of a block of a bucket.
STAR_BLOCK, BUCKET_BLOCK = 256, 1024
#: How far below the threshold a sketch's estimate may be before the pair is ruled out.
MARGIN = 0.13
EMPTY = U(0xFFFFFFFFFFFFFFFF)
#: What tells sets apart; parts of a class of equal sets.
SET, SALTS = ["d1", "d2", "n_shingles"], 256


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Each document's distinct shingle hashes, ascending, and where each document's begin."""
    hashes, starts = words.hashes()[words.codes], words.starts
    lengths = np.diff(starts)
    counts = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(bounds[-1], np.uint64)
    for width in range(1, size + 1):
        docs = np.flatnonzero(lengths >= size) if width == size else np.flatnonzero(lengths == width)
        if not len(docs):
            continue
        n = counts[docs]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(starts[docs], n) + within
        h = np.full(len(at), U(width))
        for k in range(width):
            h *= POLY
            h += hashes[at + k]
        out[np.repeat(bounds[docs], n) + within] = mix(h)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    firsts = bounds[:-1][counts > 0]
    new[firsts] = True
    return out[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def sketches(values: np.ndarray, starts: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """A row of ``size`` coordinates for each document; a document without values keeps EMPTY everywhere."""
    n_docs = len(starts) - 1
    table = np.full(n_docs * size, EMPTY)
    counts = np.diff(starts)
    left = np.flatnonzero(counts > 0)
    for turn in range(2 * size):
        if not len(left):
            break
        n = counts[left]
        ends = np.cumsum(n)
        if len(left) == n_docs:
            at = slice(None)
        else:
            at = np.arange(ends[-1]) + np.repeat(starts[left] - (ends - n), n)
        h = mix(values[at] + U(int(GOLD) * (turn + 1) & 0xFFFFFFFFFFFFFFFF))
        key = (U(turn) << U(32)) | (h & U(0xFFFFFFFF))
        if turn < size:
            bins = ((h >> U(32)) * U(size)) >> U(32)
            np.minimum.at(table, np.repeat(left * size, n) + bins.astype(np.int64), key)
        else:
            least = np.minimum.reduceat(key, ends - n)
            cell = left * size + (turn - size)
            table[cell] = np.minimum(table[cell], least)
        left = left[(table.reshape(n_docs, size)[left] == EMPTY).any(axis=1)]
    return table.reshape(n_docs, size)


def band_keys(table: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each sketch."""
    rows = table.reshape(len(table), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key * POLY + rows[:, :, k])
    return key


def _lists(values: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), flat)


def _binaries(values: np.ndarray) -> pa.Array:
    """Each row of a 2-d array as one binary value."""
    width = values.shape[1] * values.itemsize
    offsets = np.arange(0, values.size * values.itemsize + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole):
            values, starts = shingle_sets(split_words(batch["text"]))
            table = sketches(values, starts)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(starts)), pa.array(sums(mix(values + GOLD), starts).view(np.int64)), pa.array(sums(mix(values ^ POLY), starts).view(np.int64)), _lists(band_keys(table)), _binaries((table & U(0xFF)).astype(np.uint8))],
                ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"],
            )


def sketch_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit digest of the set (d1, d2), band keys and the sketch's low 8 bits (two differing coordinates agree in them once in 256)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(_sketched), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, centre_set = None, None
        for batch in batches:
            values, starts = shingle_sets(split_words(batch["text"]))
            a, b, salt = batch["centre"].to_pylist(), batch["doc_id"].to_pylist(), batch["salt"].to_pylist()
            role = batch["role"].to_pylist()
            left, right = [], []
            for k in range(batch.num_rows):
                own = values[starts[k] : starts[k + 1]]
                if role[k] == 0:
                    centre, centre_set = (a[k], salt[k]), own
                elif centre == (a[k], salt[k]):
                    both = len(np.intersect1d(centre_set, own, assume_unique=True))
                    if 100 * both >= threshold * (len(centre_set) + len(own) - both) and both:
                        left.append(a[k])
                        right.append(b[k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def confirm(docs: DataFrame, pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach threshold percent. Each centre's text goes once to each salted group."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).cast("int").alias("k"))
    members = pairs.join(salts, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("centre"), F.pmod(F.xxhash64("b"), "k").cast("int").alias("salt"), F.lit(1).alias("role"))
    centres = salts.select(F.col("a").alias("doc_id"), F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("role"))
    routed = docs.join(members.unionByName(centres).hint("merge"), "doc_id")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = routed.repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "role")
    return grouped.mapInArrow(tidy(_confirmed(threshold)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of every node of an edge: comp is the least node that can be reached."""
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        heard = both.join(label, both.b == label.node).groupBy(F.col("a").alias("n")).agg(F.min("comp").alias("heard"))
        near = label.join(heard, label.node == heard.n, "left").select("node", F.col("comp").alias("old"), F.least("comp", F.coalesce("heard", "comp")).alias("comp"))
        up = label.select(F.col("node").alias("up"), F.col("comp").alias("top"))  # joined as is: Spark splits the rows of a label of many nodes
        new = stage(near.join(up, near.comp == up.up, "left").select("node", "old", F.least("comp", F.coalesce("top", "comp")).alias("comp")), "labels")
        if new.filter("comp <> old").limit(1).count() == 0:
            return new.select("node", "comp")
        label = new.select("node", "comp")


def _compared(least: float, best: bool):
    """For a block of a bucket's outsiders (role 0) and one of all its members (role 1), pairs of members of different
    components: with ``best`` the likest y of each outsider x as (x, y, likeness), else the pairs of components (x, y)."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rep, comp, n, role = (table[c].to_numpy() for c in ("rep", "comp", "n_shingles", "role"))
        rows = table["sketch"].combine_chunks()
        rows = np.frombuffer(rows.buffers()[2], np.uint8)[rows.offset * COORDINATES :][: len(rep) * COORDINATES].reshape(-1, COORDINATES)
        found, likest, other = set(), [], np.flatnonzero(role == 1)
        for x in np.flatnonzero(role == 0):
            y = other[(comp[other] != comp[x]) & (100 * n[other] >= 75 * n[x]) & (100 * n[x] >= 75 * n[other])]
            if not len(y):
                continue
            agree = (rows[y] == rows[x]).mean(axis=1)
            if best:
                k = int(agree.argmax())
                if agree[k] >= least:
                    likest.append((int(rep[x]), int(rep[y[k]]), float(agree[k])))
            else:
                found.update((int(min(comp[x], c)), int(max(comp[x], c))) for c in np.unique(comp[y[agree >= least]]))
        rows_ = likest if best else [(a, b, 1.0) for a, b in found]
        left, right, likeness = (list(c) for c in zip(*rows_, strict=True)) if rows_ else ([], [], [])
        return pa.table({"x": pa.array(left, pa.int64()), "y": pa.array(right, pa.int64()), "likeness": pa.array(likeness, pa.float64())})

    return run


def _mixed(named: DataFrame) -> DataFrame:
    """Buckets of several components: key, their largest component, numbers of blocks of outsiders and of members."""
    sizes = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    whole = sizes.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    blocks = lambda n: F.ceil(n / BUCKET_BLOCK).cast("int")
    return whole.filter(F.col("all") > F.col("most")).select("key", "main", blocks(F.col("all") - F.col("most")).alias("n_out"), blocks(F.col("all")).alias("n_all"))


def _across(named: DataFrame, mixed: DataFrame, reps: DataFrame, least: float, best: bool) -> DataFrame:
    """What _compared() finds in buckets that hold several components. named: key, rep, comp.

    Members of a bucket's largest component meet only the others, so a bucket of one large component and a few
    outsiders is sent about once.
    """
    open_ = named.join(mixed, "key")
    block = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "i", "j", "rep", "comp", "role"]
    members = open_.withColumn("j", block(F.col("n_all"))).withColumn("i", every("n_out")).withColumn("role", F.lit(1)).select(columns)
    outside = open_.filter("comp <> main").withColumn("i", block(F.col("n_out"))).withColumn("j", every("n_all")).withColumn("role", F.lit(0)).select(columns)
    spread = members.union(outside).join(reps.select("rep", "n_shingles", "sketch"), "rep").select(*columns, "n_shingles", "sketch")
    return spread.groupBy("key", "i", "j").applyInArrow(_compared(least, best), "x long, y long, likeness double")


def _linked(threshold: int):
    """Links between the x and the y documents of each group, on full sets. Rows come sorted by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        key = None

        def flush() -> pa.RecordBatch:
            ys = [h for h in held if h[1] == 1]
            left, right = [], []
            if ys:
                sizes = np.array([len(h[3]) for h in ys])
                values = np.concatenate([h[3] for h in ys])
                order = np.argsort(values, kind="stable")
                values, owner = values[order], np.repeat(np.arange(len(ys)), sizes)[order]
                ids, comps = np.array([h[0] for h in ys]), np.array([h[2] for h in ys])
                for rep, role, comp, own in held:
                    if role == 0 and len(own):
                        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
                        n = hi - lo
                        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                        both = np.bincount(owner[at], minlength=len(ys))
                        for k in np.flatnonzero((100 * both >= threshold * (len(own) + sizes - both)) & (both > 0) & (comps != comp)):
                            left.append(min(rep, int(ids[k])))
                            right.append(max(rep, int(ids[k])))
            return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        for batch in batches:
            sets, starts = shingle_sets(split_words(batch["text"]))
            rows = zip(*(batch[c].to_pylist() for c in ("big", "xb", "yb", "doc_id", "role", "comp")), strict=True)
            for k, (big, xb, yb, rep, role, comp) in enumerate(rows):
                if key != (big, xb, yb):
                    if held:
                        yield flush()
                    held, key = [], (big, xb, yb)
                held.append((rep, role, comp, sets[starts[k] : starts[k + 1]].copy()))
        if held:
            yield flush()

    return run


def _between(pairs: DataFrame, members: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """Links between members of the given pairs of components (x, y). members: rep, comp.

    A larger component meets all the smaller ones paired with it at once, block against block, so a text is sent once
    for every STAR_BLOCK documents on the other side and no pair of documents is a row.
    """
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("m"))
    sized = pairs.join(sizes.select(F.col("comp").alias("x"), F.col("m").alias("mx")), "x").join(sizes.select(F.col("comp").alias("y"), F.col("m").alias("my")), "y")
    first = (F.col("mx") > F.col("my")) | ((F.col("mx") == F.col("my")) & (F.col("x") < F.col("y")))
    sided = stage(sized.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("big"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("comp"), F.when(first, F.col("mx")).otherwise(F.col("my")).alias("n_y"), F.least("mx", "my").alias("n_x")), "sides")
    blocks = sided.groupBy("big").agg(F.ceil(F.sum("n_x") / STAR_BLOCK).cast("int").alias("kx"), F.ceil(F.first("n_y") / STAR_BLOCK).cast("int").alias("ky"))
    rows = sided.select("big", "comp", F.lit(0).alias("role")).unionByName(blocks.select("big", F.col("big").alias("comp"), F.lit(1).alias("role")))
    rows = rows.join(members, "comp").join(blocks, "big")
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("role") == 0, F.col("kx")).otherwise(F.col("ky"))).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("role") == 0, F.col("ky")).otherwise(F.col("kx")) - 1))
    rows = rows.withColumn("own", own).withColumn("other", others)
    side = lambda zero: F.when(F.col("role") == zero, F.col("own")).otherwise(F.col("other"))
    dealt = rows.select("big", side(0).alias("xb"), side(1).alias("yb"), F.col("rep").alias("doc_id"), "role", "comp")
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = texts.join(dealt.hint("merge"), "doc_id").repartition(n, "big", "xb", "yb").sortWithinPartitions("big", "xb", "yb", "role")
    return routed.select("big", "xb", "yb", "doc_id", "role", "comp", "text").mapInArrow(tidy(_linked(threshold)), "a long, b long")


def _classes(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(salted part of each class of equal sets, classes with rep, the least doc_id). A class has SALTS parts at most, so
    no join or grouping takes a large class in one task."""
    parts = stage(sketched.filter("n_shingles > 0").withColumn("salt", _salt()).groupBy(*SET, "salt").agg(F.min("doc_id").alias("rep")), "parts")
    return parts, parts.groupBy(*SET).agg(F.min("rep").alias("rep"))


def _salt() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (least reachable doc_id), kept (doc_id = component_id), class_id.

    class_id is the least doc_id with exactly the same set. Links are 100 * intersection >= threshold * union over
    full sets. Nulls and texts without words: n_shingles 0, linked with nothing. Rows that repeat a doc_id give a
    row each; sets that share their least doc_id share its links, which are those of the set with the least digest. A
    row without a doc_id is linked with nothing: component_id and class_id are null, kept is true. Very long texts are
    taken whole; ties go to the least doc_id. An empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = rows.filter("doc_id is not null")
    sketched = stage(sketch_documents(rows), "sketches")
    unnamed = sketched.filter("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"), F.lit(None).cast("long").alias("class_id"))
    sketched = sketched.filter("doc_id is not null")
    parts, classes = _classes(sketched)
    firsts = classes.groupBy("rep").agg(F.min(F.struct(*SET)).alias("s")).select("rep", "s.*")
    own = [F.col("doc_id") == F.col("rep"), *(F.col(f"o.{c}") == F.col(f"f.{c}") for c in SET)]
    reps = stage(sketched.filter("n_shingles > 0").alias("o").join(firsts.hint("merge").alias("f"), own, "left_semi").select(F.col("doc_id").alias("rep"), "n_shingles", "bands", "sketch").dropDuplicates(["rep"]), "reps")
    buckets = reps.select("rep", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").drop("z")
    together = stage(buckets.join(shared.hint("merge"), "key"), "buckets")
    texts = stage(docs.join(together.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "texts")
    together, reps = together.select("key", "rep", "a"), reps.drop("bands")
    tested = stage(together.filter("a <> rep").groupBy(F.col("rep").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    edges = stage(confirm(texts, tested, threshold), "links")
    label = components(edges)
    everyone = together.select("rep").distinct()
    for best in (True, True, False):
        members = stage(everyone.join(label, everyone.rep == label.node, "left").select("rep", F.coalesce("comp", "rep").alias("comp")), "components")
        named = stage(together.select("key", "rep").join(members, "rep"), "named")
        mixed = stage(_mixed(named), "mixed")
        if not mixed.limit(1).count():
            break
        across = _across(named, mixed, reps, threshold / 100 - MARGIN, best)
        if best:
            likest = across.groupBy("x").agg(F.max_by("y", F.struct("likeness", "y")).alias("y"))
            pairs = stage(likest.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"), "pairs")
            new, tested = stage(confirm(texts, pairs, threshold), "links"), tested.union(pairs)
        else:
            new = stage(_between(stage(across.select("x", "y").distinct(), "pairs"), members, texts, threshold), "links")
        if new.limit(1).count():
            edges = edges.union(new)
            label = components(edges)
    labelled = classes.join(label, classes.rep == label.node, "left").select(*SET, F.col("rep").alias("class_id"), F.coalesce("comp", "rep").alias("component_id"))
    answers = parts.select(*SET, "salt").join(labelled, SET)
    found = sketched.select("doc_id", *SET).withColumn("salt", _salt()).join(answers, [*SET, "salt"], "left")
    component, class_ = F.coalesce("component_id", "doc_id"), F.coalesce("class_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), class_.alias("class_id")).unionByName(unnamed)
