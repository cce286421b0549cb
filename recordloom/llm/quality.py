"""Document quality by hierarchical empirical Bayes.

A logistic classifier on words and on the text's shape gives each document's own evidence for two properties, quality
and toxicity. Sites add theirs: for each property the host's rate, and within it the path's, are posterior means of
beta priors. A host's prior is centred on the corpus rate and a path's on its host's; the strengths come from the
variance between hosts and between paths beyond what their sizes explain (method of moments), so sparse sites shrink
to their parent and uniform corpora shrink everything. A labelled document counts in these sums with its label, any
other with its classifier probability. The final log-odds add the path's log-odds relative to the corpus.

The classifier is fitted on at most SAMPLE labelled rows (least hash of the id), of which near copies count once,
with their mean label, so that a mislabelled original and its copies don't pass for evidence; the grouped sums cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.near_duplicates import shingle_sets
from recordloom.llm.staging import SALTS, look_up, stage
from recordloom.llm.textblocks import U, distinct, mix, owners, release, slices, split_words, tidy

SAMPLE, FEATURES, LEAST_Z, LEAST_DF, LEAST_SHIFT, RIDGE = 4000, 600, 6.0, 8, 0.25, 1.0
PREFIXES = (3, 5, 7)
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~"]] = True
#: Edges of the bins of shape features.
EDGES = {"distinct": np.arange(0.1, 1.0, 0.1), "symbols": np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.4]), "capitals": np.array([0.02, 0.1, 0.3, 0.6]), "length": np.array([4, 16, 64, 256, 1024, 4096])}
SHAPES = sum(len(e) + 1 for e in EDGES.values())


def read(texts: pa.Array) -> tuple[list[pa.Array], np.ndarray, np.ndarray, np.ndarray]:
    """(forms of the vocabulary, codes, word starts, one-hot shape features) of whole texts.

    The forms of a word are the word without outer punctuation and its beginnings of PREFIXES code points.
    """
    texts = pc.fill_null(texts, "")
    words = split_words(texts)
    n = np.diff(words.starts)
    of = owners(words.starts)
    pairs = distinct(of * np.int64(len(words.vocabulary) + 1) + words.codes)
    variety = np.bincount(pairs // (len(words.vocabulary) + 1), minlength=len(n)) / np.maximum(n, 1)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    size = np.maximum(np.diff(offsets), 1)
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / size
    values = {"distinct": variety, "symbols": share(SYMBOLS[raw]), "capitals": share((raw >= 65) & (raw <= 90)), "length": n}
    shape, at = np.zeros((len(n), SHAPES)), 0
    for name, edges in EDGES.items():
        shape[np.arange(len(n)), at + np.searchsorted(edges, values[name], "right")] = 1
        at += len(edges) + 1
    bare = pc.utf8_lower(pc.ascii_trim(words.vocabulary, PUNCTUATION))
    bare = pc.if_else(pc.equal(bare, ""), words.vocabulary, bare)
    forms = [bare, *(pc.binary_join_element_wise(pa.scalar("^"), pc.utf8_slice_codeunits(bare, 0, k), pa.scalar("")) for k in PREFIXES)]
    return forms, words.codes, words.starts, shape


def presence(starts: np.ndarray, codes: np.ndarray, place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, feature) pairs; ``place`` maps a vocabulary entry to its feature or -1."""
    at = place[codes]
    used = np.flatnonzero(at >= 0)
    pairs = distinct(owners(starts)[used] * np.int64(n + 1) + at[used])
    return pairs // (n + 1), pairs % (n + 1)


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-6
    loss = lambda v: np.logaddexp(0, x @ v).sum() - y @ (x @ v) + 0.5 * (ridge * v * v).sum()
    now = loss(w)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step /= 2
        w, gain, now = w + step, now - new, new
        if gain < 1e-6 * len(y):
            break
    return w


def groups(texts: list[str]) -> np.ndarray:
    """The group of each text: texts with the same least hash of their five-word shingles, under each of three hashes."""
    values, starts = shingle_sets(split_words(pa.array(texts, pa.string())))
    seen: dict[tuple, int] = {}
    out = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        key = tuple(int(mix(values[a:b] + U(salt)).min()) for salt in (1, 2, 3)) if b > a else ()
        out.append(seen.setdefault(key, len(seen)))
    return np.array(out, np.int64)


class Classifier:
    """Two logistic models over the presence of selected words and the shape features."""

    def __init__(self, texts: list[str], labels: np.ndarray):
        of = groups(texts)
        first = np.unique(of, return_index=True)[1]
        texts, labels = [texts[k] for k in first], np.stack([np.bincount(of, weights=y) / np.bincount(of) for y in labels.T], axis=1)
        forms, codes, starts, shape = read(pa.array(texts, pa.string()))
        coded = pa.concat_arrays(forms).dictionary_encode()
        size, merged = len(coded.dictionary), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pairs = [presence(starts, codes, part, size) for part in np.split(merged, len(forms))]
        doc, word = (np.concatenate(x) for x in zip(*pairs, strict=True))
        df = np.bincount(word, minlength=size).astype(float)
        own = []
        for y in labels.T:
            rate, n = y.mean(), len(y)
            got = np.bincount(word, weights=y[doc], minlength=len(df))
            z = np.abs(got - df * rate) / np.sqrt(np.maximum(df * rate * (1 - rate) * (1 - df / n), 1e-9) + 1e-6)
            z[(df < LEAST_DF) | (np.abs(got / np.maximum(df, 1) - rate) < LEAST_SHIFT)] = 0  # a common word may be sure of a small shift
            own.append([k for k in np.argsort(-z, kind="stable")[: FEATURES // 2] if z[k] >= LEAST_Z])
        chosen = sorted({k for some in own for k in some})
        self.words = coded.dictionary.take(pa.array(chosen, pa.int64()))
        x = np.zeros((len(labels), len(chosen)))
        place = np.full(len(df), -1)
        place[chosen] = np.arange(len(chosen))
        used = place[word] >= 0
        x[doc[used], place[word][used]] = 1
        self.weights = np.zeros((len(chosen) + SHAPES + 1, labels.shape[1]))
        for j, (some, y) in enumerate(zip(own, labels.T, strict=True)):
            rows = np.concatenate([place[some].astype(np.int64), np.arange(len(chosen), len(chosen) + SHAPES + 1)])
            self.weights[rows, j] = logistic(np.hstack([x[:, place[some].astype(np.int64)], shape]), y)

    def score(self, texts: pa.Array) -> np.ndarray:
        """Log-odds of each property for each text."""
        forms, codes, starts, shape = read(texts)
        n = len(self.words)
        out = shape @ self.weights[n:-1] + self.weights[-1]
        for form in forms:
            place = pc.fill_null(pc.index_in(form, self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            doc, word = presence(starts, codes, place, n)
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(doc, weights=self.weights[word, k], minlength=len(out))
        return out


def _scored(model: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                scores = model.score(pa.concat_arrays([batch["text"]]))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["host"], batch["path"], pa.array(scores[:, 0]), pa.array(scores[:, 1])], ["doc_id", "host", "path", "quality", "toxic"])

    return run


def _sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _strength(between: float | None, mean: float) -> float:
    """The pseudo-count of a beta prior with this mean and this variance between groups."""
    return float(np.clip(mean * (1 - mean) / max(between or 0.0, 1e-9) - 1, 1.0, 1e6))


def assess(docs: DataFrame, labels: DataFrame, host: str = "source", path: Column | None = None, least_quality: float = 0.5, most_toxic: float = 0.25) -> DataFrame:
    """doc_id, quality, toxicity (posterior probabilities), document_quality, document_toxicity (text alone), kept.

    kept: quality >= least_quality and toxicity < most_toxic. ``host`` names a column, ``path`` is an expression; a
    null host or path is a site of its own. labels: doc_id, quality, toxic (0 or 1); rows with a null or without a document don't count; repeated
    labels are averaged. Null texts are empty, very long ones are read whole. A tie with a threshold is kept for
    quality and rejected for toxicity. Repeated rows give rows each; an empty table gives none; without
    labels all rows have probability 0.5 and are kept. Other columns are ignored.
    """
    site = F.coalesce(F.col(host).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), site.alias("host"), F.coalesce(path.cast("string") if path is not None else F.lit(""), F.lit("")).alias("path"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("lq"), F.col("toxic").cast("double").alias("lt")).dropna().groupBy("doc_id").agg(F.avg("lq").alias("lq"), F.avg("lt").alias("lt"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    one = F.min_by(F.struct("text", "lq", "lt"), F.struct(F.xxhash64("text"), "text")).alias("one")  # of rows that share an id
    sample = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.*").toPandas().sort_values("doc_id")
    if not len(sample):
        half = F.lit(0.5)
        return rows.select("doc_id", half.alias("quality"), half.alias("toxicity"), half.alias("document_quality"), half.alias("document_toxicity"), F.lit(True).alias("kept"))
    model = Classifier(sample["text"].tolist(), (sample[["lq", "lt"]].to_numpy() >= 0.5).astype(float))
    del sample
    release()  # the fit ran on the driver
    scored = rows.mapInArrow(tidy(_scored(model)), "doc_id long, host string, path string, quality double, toxic double")
    unnamed = F.when(F.col("doc_id").isNull(), 1 + F.pmod(F.xxhash64("quality", "toxic"), F.lit(SALTS))).otherwise(0)  # rows without an id don't meet in one task
    scored = scored.withColumn("_salt", unnamed).join(known.withColumn("_salt", F.lit(0).cast("long")), ["doc_id", "_salt"], "left").select("doc_id", "host", "path", "quality", "toxic", F.coalesce("lq", _sigmoid(F.col("quality"))).alias("q"), F.coalesce("lt", _sigmoid(F.col("toxic"))).alias("t"))
    scored = stage(scored, "evidence")
    sums = [F.count(F.lit(1)).alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")]
    paths = stage(scored.groupBy("host", "path").agg(*sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("q").alias("q"), F.sum("t").alias("t")).first()
    if not total["n"]:
        return scored.select("doc_id", F.col("q").alias("quality"), F.col("t").alias("toxicity"), F.col("q").alias("document_quality"), F.col("t").alias("document_toxicity"), F.lit(True).alias("kept"))
    mean = {c: min(max(total[c] / total["n"], 1e-4), 1 - 1e-4) for c in "qt"}
    joined = paths.join(hosts.select("host", *[F.col(c).alias(f"h{c}") for c in "nqt"]), "host")

    def beyond(c: str, n: str, centre: Column) -> Column:
        """Variance of the rates about ``centre`` beyond binomial noise, weighted by size."""
        rate = F.col(c) / F.col(n)
        return (F.sum(F.col(n) * (rate - centre) ** 2) - F.sum(F.lit(mean[c[-1]] * (1 - mean[c[-1]])))) / F.sum(n)

    spread = joined.agg(*[beyond(c, "n", F.col(f"h{c}") / F.col("hn")).alias(c) for c in "qt"]).first()
    wide = hosts.agg(*[beyond(c, "n", F.lit(mean[c])).alias(c) for c in "qt"]).first()
    for c in "qt":
        k_host, k_path = _strength(wide[c], mean[c]), _strength(spread[c], mean[c])
        joined = joined.withColumn(f"{c}_host", (F.col(f"h{c}") + k_host * mean[c]) / (F.col("hn") + k_host))
        joined = joined.withColumn(f"{c}_site", (F.col(c) + k_path * F.col(f"{c}_host")) / (F.col("n") + k_path))
    sites = joined.select("host", "path", *[(_logit(F.col(f"{c}_site")) - _logit(F.lit(mean[c]))).alias(f"{c}_shift") for c in "qt"])
    fused = look_up(scored, sites, ["host", "path"], F.struct("doc_id", "quality", "toxic"), "inner")
    quality, toxic = _sigmoid(F.col("quality") + F.col("q_shift")), _sigmoid(F.col("toxic") + F.col("t_shift"))
    return fused.select("doc_id", quality.alias("quality"), toxic.alias("toxicity"), _sigmoid(F.col("quality")).alias("document_quality"), _sigmoid(F.col("toxic")).alias("document_toxicity"), ((quality >= least_quality) & (toxic < most_toxic)).alias("kept"))
