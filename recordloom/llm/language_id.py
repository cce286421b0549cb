"""Language identification by Bayesian evidence fusion.

Evidence of a document: its text (a multinomial over hashed byte trigrams for each language), the language its markup
or metadata declares, the suffix of its address, and its host. The posterior is the normalised product of

* the text's likelihood, tempered by TEMPER because overlapping trigrams are not independent,
* P(declared | language) and P(suffix | language), from grouped counts of the text's own decisions, with add-one
  smoothing, so a declaration weighs as much as it has proved reliable,
* a prior over languages of the host, smoothed towards its parent domain and that towards the corpus:
  (counts + KAPPA prior of the parent) / (n + KAPPA), by grouped aggregation over all rows.

The class ``und`` stands for text of none of the languages: under it all trigrams are equally likely, so it loses to a
language's model on that language and wins where most trigrams are unknown to all. A row is rejected if ``und`` wins; a text without letters leaves the decision to the other evidence, and without any of it is rejected.

The languages are all well-formed codes that any row declares. The text model is fitted on a bounded sample of each: the
SAMPLE / languages (LEAST at least) distinct rows with the least hash of id and text; all counts and priors cover all
rows. A table of 2^BITS numbers a language goes to the tasks, so memory grows with the number of declared codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.staging import look_up, stage
from recordloom.llm.textblocks import slices, tidy

SAMPLE, LEAST, TEMPER, KAPPA, UND, BITS = 4000, 100, 0.25, 20.0, "und", 16
#: Bytes of host priors that may be broadcast, and parts in which a language's sample is first cut down.
MOST_BYTES, PARTS = 20_000_000, (64, 8)
#: Texts that the model counts at once.
FITTED = 100
#: Codes that name no language.
NO_LANGUAGE = [UND, "mis", "mul", "zxx"]
#: Bytes that are no letters count as one separator.
FOLD = np.array([b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)


def trigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, the middle byte of each, and where each text's begin. Separators don't repeat."""
    texts = pc.fill_null(texts, "")
    lowered = pc.utf8_lower(pc.binary_join_element_wise(texts.cast(pa.string()), pa.scalar(" "), pa.scalar(" ")))
    offsets = np.frombuffer(lowered.buffers()[1], np.int32)[lowered.offset :][: len(lowered) + 1].astype(np.int64)
    raw = FOLD[np.frombuffer(lowered.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]] if len(lowered) else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kept = np.ones(len(raw), bool)
    kept[1:] = (raw[1:] != 32) | (raw[:-1] != 32)
    starts = np.concatenate([[0], np.cumsum(kept)])[offsets]
    raw = raw[kept].astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(len(starts), np.int64)
    hashed = ((raw[:-2] << np.uint32(16) | raw[1:-1] << np.uint32(8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return hashed, raw[1:-1].astype(np.uint8), np.minimum(starts, len(hashed))


class TextModel:
    """log P(trigram | language) for each bucket."""

    def __init__(self, languages: list[str], texts: list[str], declared: list[str]):
        self.languages = languages
        codes, counts = np.array([languages.index(d) for d in declared], np.int64), np.zeros(len(languages) << BITS)
        for at in range(0, len(texts), FITTED):
            hashed, _, starts = trigrams(pa.array(texts[at : at + FITTED], pa.string()))
            of = np.repeat(codes[at : at + FITTED], np.diff(starts))
            place, n = np.unique((of << BITS) + hashed[: len(of)], return_counts=True)
            counts[place] += n
        counts = counts.reshape(len(languages), -1)
        self.table = np.log((counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * (1 << BITS))).T.astype(np.float32)

    def score(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log likelihoods by text and class, ``und`` last; number of trigrams with a letter)."""
        hashed, middle, starts = trigrams(texts)
        out = np.zeros((len(starts) - 1, len(self.languages) + 1))
        lettered = middle != 32
        n = np.concatenate([[0], np.cumsum(lettered)])
        for k in range(len(starts) - 1):
            a, b = starts[k], starts[k + 1]
            if b > a:
                use = lettered[a:b]
                out[k, :-1] = self.table[hashed[a:b][use]].sum(axis=0, dtype=np.float64)
                out[k, -1] = -np.log(2.0) * BITS * use.sum()
        return out, n[starts[1:]] - n[starts[:-1]]


def _scored(model: TextModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                scores, n = model.score(batch["text"])
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32)), pa.array(scores.ravel()))
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["declared"], batch["suffix"], batch["host"], flat, pa.array(n)], ["doc_id", "declared", "suffix", "host", "loglik", "n_grams"])

    return run


def parent(host: Column) -> Column:
    """The host without its first label; null once no dot is left."""
    return F.when(host.contains("."), F.regexp_replace(host, r"^[^.]*\.", ""))


def markup_language(html: Column) -> Column:
    """What the lang attribute of a page's html element says; null if there is none."""
    return F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?is)<html\b[^>]*?\s(?:xml:)?lang\s*=\s*["']?\s*([a-z]{2,3}(?:-\w+)*)""", 1), F.lit(""))


def suffix_of(url: Column) -> Column:
    """A two-letter first path segment or top-level domain of an address, lower-case; null if neither."""
    path = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    top = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\w+://[^/:?#]*\.([A-Za-z]{2})(?:[:/?#]|$)", 1))
    return F.when(path != "", path).when(top != "", top)


def _least(each: int):
    """(declared, order) of the ``each`` least distinct orders of each language in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, np.ndarray] = {}
        for batch in batches:
            coded = batch["declared"].dictionary_encode()
            codes, order = coded.indices.to_numpy(zero_copy_only=False), batch["order"].to_numpy()
            for k, name in enumerate(coded.dictionary.to_pylist()):
                best[name] = np.unique(np.append(best.get(name, order[:0]), order[codes == k]))[:each]
        for name, order in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(order)), pa.array(order)], ["declared", "order"])

    return run


def _sample(rows: DataFrame, languages: list[str]) -> tuple[list[str], list[str]]:
    """(texts, declared) of a bounded sample of each language."""
    each = max(SAMPLE // len(languages), LEAST)
    told = rows.filter(F.col("declared").isin(languages)).withColumn("order", F.xxhash64("doc_id", "text"))
    least = told.select("declared", "order").mapInArrow(tidy(_least(each)), "declared string, order long")
    for parts in PARTS:  # so that one task never has all tasks' rows of a language
        least = least.repartition("declared", F.pmod("order", F.lit(parts))).mapInArrow(tidy(_least(each)), "declared string, order long")
    least = least.distinct()
    nth = F.row_number().over(Window.partitionBy("declared").orderBy("order"))
    last = least.withColumn("nth", nth).filter(F.col("nth") <= each).groupBy("declared").agg(F.max("order").alias("last"))
    used = told.join(F.broadcast(last), "declared").filter("order <= last").select("declared", "text", "order").repartition("declared", "order").dropDuplicates(["declared", "order"]).toPandas()
    return used["text"].tolist(), used["declared"].tolist()


def _given(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(column, given): log P(value | language) of each value. There are at most 26^2 + 26^3 values, so none is dropped.

    Besides add-one smoothing, a value that names a language is counted once more as right.
    """
    n = len(names)
    sums = [F.sum(F.element_at("soft", k + 1)).alias(f"s{k}") for k in range(n)]
    found = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(*sums).collect()
    values = [r[column] for r in found] + sorted({*names} - {UND} - {r[column] for r in found})
    table = np.array([[r[f"s{k}"] for k in range(n)] for r in found] + [[0.0] * n] * (len(values) - len(found))).reshape(len(values), n)
    table += [[value == name for name in names] for value in values]
    logs = np.log((table + 1) / (table.sum(axis=0) + len(values) + 1))
    return rows.sparkSession.createDataFrame(list(zip(values, logs.tolist(), strict=True)), f"{column} string, {column}_given array<double>")


def _softmax(logs: Column) -> Column:
    shifted = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def identify(docs: DataFrame, declared: str | None = "lang", url: str | None = None, host: str | None = "source") -> DataFrame:
    """doc_id, language, posterior, text_language (by the text alone), n_grams, kept (not rejected), for each row.

    ``declared``, ``url`` and ``host`` name columns or are None; nulls in them are missing evidence. Null or empty
    text leaves the other evidence. Very long texts are read whole; of equally likely languages the first code is
    taken. Without any row that declares a language, every row is ``und``. Repeated rows
    give rows each and count each; an empty table gives none. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    missing = F.lit(None).cast("string")
    named = F.lower(F.trim(F.col(declared).cast("string"))) if declared else missing
    address = F.col(url).cast("string") if url else missing
    site = F.lower(F.col(host).cast("string")) if host else F.nullif(F.lower(F.regexp_extract(F.coalesce(address, F.lit("")), r"^\w+://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.regexp_extract(F.coalesce(F.nullif(named, F.lit("")), F.lit("")), r"^([a-z]{2,3})\b", 1).alias("declared"), suffix_of(address).alias("suffix"), site.alias("host"))
    rows = rows.withColumn("declared", F.nullif("declared", F.lit("")))
    told = rows.filter(F.col("declared").isNotNull() & ~F.col("declared").isin(NO_LANGUAGE))
    languages = sorted(r["declared"] for r in told.select("declared").distinct().collect())  # at most 26^2 + 26^3
    if not languages:
        return rows.select("doc_id", F.lit(UND).alias("language"), F.lit(1.0).alias("posterior"), F.lit(UND).alias("text_language"), F.lit(0).cast("long").alias("n_grams"), F.lit(False).alias("kept"))
    model = TextModel(languages, *_sample(rows, languages))
    names, n = [*languages, UND], len(languages) + 1
    scored = rows.mapInArrow(tidy(_scored(model)), "doc_id long, declared string, suffix string, host string, loglik array<double>, n_grams long")
    scored = scored.withColumn("loglik", F.transform("loglik", lambda x: x * TEMPER))
    scored = stage(scored.withColumn("soft", _softmax(F.col("loglik"))), "likelihoods")
    informed = scored.filter("n_grams > 0")
    given = [(_given(informed, column, names), column) for column in ("declared", "suffix")]
    sums = [F.sum(F.element_at("soft", k + 1)).alias(f"s{k}") for k in range(n)]
    total = informed.agg(*sums).first()
    counts = np.array([total[k] or 0.0 for k in range(n)]) + 1.0
    corpus = F.array(*[F.lit(float(x)) for x in counts / counts.sum()])
    summed = F.array(*[F.coalesce(F.col(f"s{k}"), F.lit(0.0)) for k in range(n)])
    smooth = lambda prior: F.zip_with(summed, prior, lambda s, p: (s + KAPPA * p) / (F.coalesce(F.col("m"), F.lit(0)) + KAPPA))
    counted = [F.count(F.lit(1)).alias("m"), *sums]
    by_host = informed.filter("host is not null").groupBy("host").agg(*counted)
    above = by_host.select(parent(F.col("host")).alias("up"), *[c for c in by_host.columns if c != "host"]).filter("up is not null").groupBy("up").agg(F.sum("m").alias("m"), *[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
    above = above.select("up", smooth(corpus).alias("up_prior"))
    priors = by_host.withColumn("up", parent(F.col("host"))).join(above, "up", "left").withColumn("up_prior", F.coalesce("up_prior", corpus))
    priors = priors.select("host", smooth(F.col("up_prior")).alias("prior"))
    fused = look_up(scored, priors, ["host"], F.struct("doc_id", "n_grams", "loglik"), most=MOST_BYTES // (8 * n + 64)).withColumn("prior", F.coalesce("prior", corpus))
    logs = F.zip_with("loglik", F.transform("prior", F.ln), lambda a, b: a + b)
    for table, column in given:
        fused = fused.join(F.broadcast(table), column, "left")
        logs = F.zip_with(logs, F.coalesce(F.col(f"{column}_given"), F.array(*[F.lit(0.0)] * n)), lambda a, b: a + b)
    fused = fused.withColumn("logs", logs).withColumn("post", _softmax(F.col("logs")))
    label = F.array(*[F.lit(x) for x in names])
    best = F.element_at(label, F.array_position("post", F.array_max("post")).cast("int"))
    evidence = (F.col("n_grams") > 0) | F.coalesce(F.col("declared").isin(languages), F.lit(False)) | F.coalesce(F.col("suffix").isin(languages), F.lit(False))
    return fused.select(
        "doc_id",
        F.when(evidence, best).otherwise(UND).alias("language"),
        F.array_max("post").alias("posterior"),
        F.when(F.col("n_grams") > 0, F.element_at(label, F.array_position("soft", F.array_max("soft")).cast("int"))).otherwise(UND).alias("text_language"),
        "n_grams",
        (evidence & (best != UND)).alias("kept"),
    )
