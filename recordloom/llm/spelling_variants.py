"""Spelling variant grouping by Aho-Corasick halves.

A word that is one edit away from another leaves one of the other's two halves whole: the first half still begins it or
the second half still ends it. Every word therefore puts its two segments into an automaton, and every word is scanned
for all segments; a hit counts where its offset fits (0 for a first half, the end for a second half) and the lengths
differ by one at most, and then the distance is verified.

The automatons are shards: a segment goes to the shard of its kind, its word's length and the characters at the word's
edge, so a word needs to be scanned only by the shards of its own edges and of the lengths next to its own. Edges that
more than SHARD words share are dealt over several shards. Pairs are verified by numpy on the code points of a few words
at a time; they leave a task as one row for each word and each near word.

Forms point to words at least twice as frequent, so chains of forms end; they are followed by pointer doubling.

Nulls have no words, a null doc_id counts as empty text in the hash of a run, rows that repeat count as often as they
are there, of near words of one frequency the first in code-point order is the form, very long runs are words like any
other, an empty table gives no words. Other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.staging import look_up, stage

# Fixed values of the contract: what is between runs, the divisor of damaged runs, least code points and occurrences.
GAP, DIVISOR, LEAST_LENGTH, LEAST_N = r"[\x00-\x40\x5B-\x60\x7B-\xBF\x{100}-\x{10FFFF}]+", 97, 5, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of one edge in a shard, segments for which there is a shard, and code points that are compared at once.
SHARD, SEGMENTS, AT_ONCE = 10_000, 20_000, 2_000_000
#: Code points of an edge; the shorter half of the shortest word has them.
EDGE = LEAST_LENGTH // 2
PAIRS = "word string, n long, near string, near_n long"


def damaged_runs(docs: DataFrame, least: int = 1) -> DataFrame:
    """(word): the runs of ``least`` code points at least of every text in lower case (A to Z only), those whose hash
    DIVISOR divides short of one code point."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER).alias("text"))
    runs = texts.select("id", F.explode(F.split("text", GAP)).alias("run")).filter(F.char_length("run") >= least)  # a run is cut short at most
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(h % DIVISOR == 0, shorter).otherwise(F.col("run")).alias("word"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of LEAST_LENGTH code points and LEAST_N occurrences at least."""
    words = damaged_runs(docs, LEAST_LENGTH).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_N)


def _edges(kind: int, word: Column, length: Column) -> Column:
    edge = F.substr(word, F.lit(1), F.lit(EDGE)) if kind == 0 else F.substr(word, F.char_length(word) - EDGE + 1)
    return F.struct(F.lit(kind).alias("kind"), length.alias("length"), edge.alias("edge"))


def shards(counts: DataFrame) -> DataFrame:
    """(shard, word, n, kind): the words by the shards that hold one of their halves (kind 0, 1) or scan them (null)."""
    size = F.char_length("word")
    held = counts.select("word", "n", F.explode(F.array(_edges(0, F.col("word"), size), _edges(1, F.col("word"), size))).alias("at")).select("word", "n", "at.*")
    scans = counts.select("word", "n", F.explode(F.array(*[_edges(k, F.col("word"), size + d) for k in (0, 1) for d in (-1, 0, 1)])).alias("at")).select("word", "n", "at.*")
    parts = held.groupBy("kind", "length", "edge").agg(F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("parts"))
    parts = stage(parts, "parts")
    n = max(1, -(-2 * counts.count() // SEGMENTS))
    place = lambda part: F.pmod(F.xxhash64("kind", "length", "edge", part), F.lit(n)).cast("int")
    keys = ["kind", "length", "edge"]
    own = look_up(held, parts, keys, F.col("word")).withColumn("shard", place(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")))
    asked = look_up(scans, parts, keys, F.col("word"), how="inner").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("shard", place(F.col("part")))
    once = asked.select("shard", "word", "n").distinct().withColumn("kind", F.lit(None).cast("int"))
    return own.select("shard", "word", "n", "kind").unionByName(once)


def _codes(words: list[str], length: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length)


def _one_edit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of code points, whose lengths differ by one at most: whether they are one edit apart, and how many code
    points they begin with alike."""
    w = min(a.shape[1], b.shape[1])
    alike = lambda x, y: np.where((ne := x != y).any(axis=1), ne.argmax(axis=1), w)
    front = alike(a[:, :w], b[:, :w])
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1, front
    return front + alike(a[:, ::-1][:, :w], b[:, ::-1][:, :w]) >= w, front


def near_in_shard(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The near words that the halves held by one shard lead to, each pair of a word and a near word once."""
    held, scans = rows[rows["kind"].notna()], rows[rows["kind"].isna()]
    groups: dict[tuple[int, int, str], list[int]] = {}
    words, ns = held["word"].tolist(), held["n"].to_numpy()
    automaton = ahocorasick.Automaton()
    for i, (word, kind) in enumerate(zip(words, held["kind"].astype(int), strict=True)):
        half = len(word) // 2
        segment = word[half:] if kind else word[:half]
        groups.setdefault((kind, len(word), segment), []).append(i)
        automaton.add_word(segment, segment)
    if not words:
        return
    automaton.make_automaton()
    members = {k: np.array(v) for k, v in groups.items()}
    asked, asked_n = scans["word"].tolist(), scans["n"].to_numpy()
    hits: dict[tuple[int, int, int], tuple[list[int], list[np.ndarray]]] = {}  # (kind, length held, length scanned): scanned, held
    for q, word in enumerate(asked):
        size = len(word)
        for end, segment in automaton.iter(word):
            kinds = ((0,) if end + 1 == len(segment) else ()) + ((1,) if end + 1 == size else ())
            for kind in kinds:
                for length in (size - 1, size, size + 1):
                    if (found := members.get((kind, length, segment))) is not None:
                        into = hits.setdefault((kind, length, size), ([], []))
                        into[0].append(q)
                        into[1].append(found)
    for (kind, length, size), (qs, lists) in hits.items():
        most, at = max(1, AT_ONCE // size), 0
        while at < len(qs):  # whole hits, up to so many pairs
            sizes, end = 0, at
            while end < len(qs) and (end == at or sizes + len(lists[end]) <= most):
                sizes += len(lists[end])
                end += 1
            left = np.repeat(np.array(qs[at:end]), [len(x) for x in lists[at:end]])
            right = np.concatenate(lists[at:end])
            at = end
            one, which = np.unique(left, return_inverse=True)
            other, what = np.unique(right, return_inverse=True)
            a, b = _codes([asked[i] for i in one], size), _codes([words[i] for i in other], length)
            for k in range(0, len(left), most):
                near, front = _one_edit(a[which[k : k + most]], b[what[k : k + most]])
                if kind:
                    near &= front < length // 2  # else the first half has led there too
                x, y = left[k : k + most][near], right[k : k + most][near]
                yield pd.DataFrame({"word": [asked[i] for i in x], "n": asked_n[x], "near": [words[i] for i in y], "near_n": ns[y]})


def near_words(counts: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words one inserted, deleted or replaced code point apart, both ways."""
    # a group is a shard of bounded size: SEGMENTS halves on average, and the words that share their edges
    return shards(counts).groupBy("shard").applyInPandas(_in_group, PAIRS)


def _in_group(rows: pd.DataFrame) -> pd.DataFrame:
    parts = list(near_in_shard(rows))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"word": pd.Series(dtype=str), "n": pd.Series(dtype="int64"), "near": pd.Series(dtype=str), "near_n": pd.Series(dtype="int64")})


def group_variants(counts: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n): the most frequent near word, if it is at least
    twice as frequent, and where following such forms ends."""
    counts = stage(counts.select("word", F.col("n").cast("long").alias("n")), "words")
    best = near_words(counts).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    joined = counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n"))).alias("f"))
    judged = stage(joined.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    roots = follow(judged.filter("form is not null").select("word", "form"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def follow(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: each round doubles the steps, until none is left to go."""
    roots = stage(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stage(look_up(roots, ahead, ["root"], F.col("word")).select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        moved = roots.filter("moved").limit(1).count()
        roots = roots.drop("moved")
        if not moved:
            return roots


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants of all words of ``docs`` (doc_id, text)."""
    return group_variants(word_counts(docs))
