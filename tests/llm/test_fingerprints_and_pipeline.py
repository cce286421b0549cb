import collections
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from recordloom.llm import fingerprints as P
from recordloom.llm import pipeline
from recordloom.llm.ranges import cuts_of, range_of
from recordloom.llm.staging import stage


def test_edits_against_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in P.fingerprints_and_edits(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    assert len(got) == len(rows)
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        n = len(text)
        row = got[r[0]]
        assert row["n_chars"] == n and row["edited_sha256"] == hashlib.sha256((text[: n - n // 3] + after[: n // 3]).encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if order[(k + 1) % len(order)][1] == r[1]:
            assert row["near_next"] == 1
    same = collections.defaultdict(set)
    for r in rows:
        same[r[1] or ""].add(got[r[0]]["fingerprint"])
    assert all(len(x) == 1 for x in same.values())
    long = [r for r in got.values() if r["n_chars"] > 300]
    assert np.mean([r["near_edited"] for r in long]) > 0.25


def test_lexicon_against_brute_force(docs, rows):
    from recordloom.llm.textblocks import split_words

    df = collections.Counter()
    for r in rows:
        w = split_words(pa.array([r[1]], pa.string()))
        df.update(set(w.hashes().tolist()))
    n = len(rows)
    want = sorted(h for h, c in df.items() if max(2, 0.05 * n) <= c <= max(2, 0.5 * n))
    assert P.lexicon(docs, 0.05, 0.5).tolist() == want


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 % 2**64
    x ^= x >> 27
    x = x * 0x94D049BB133111EB % 2**64
    return x ^ x >> 31


GOLD = 0x9E3779B97F4A7C15


def brute_print(text, lexicon):
    """(whole, first rate, {(seed, rate): hash of what the fixed sub-lexicon leaves}) of one text, term by term."""
    terms = {int(t) for t in P.term_sets(pa.array([text], pa.string()))[0]}
    terms = sorted(terms & lexicon or terms)
    if not terms:
        return 0, 0, {}
    hashed = lambda some: mix(sum(mix((t + GOLD) % 2**64) for t in some) % 2**64)
    first = min(max(len(terms).bit_length() - 2, 1), P.RATES - P.SHOWN + 1)
    parts = {}
    for seed in range(P.SEEDS):
        number = {t: mix(t ^ GOLD * (seed // 2 * 2 + 1) % 2**64) >> 32 * (seed % 2) & 0xFFFFFFFF for t in terms}
        for rate in range(first, first + P.SHOWN):
            left = [t for t in terms if number[t] < 2 ** (32 - rate)]
            if left:
                parts[seed, rate] = hashed(left) >> 48 | 1
    return hashed(terms) | 1, first, parts


def brute_likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    rates = set(range(a[1], a[1] + P.SHOWN)) & set(range(b[1], b[1] + P.SHOWN))
    either = [k for k in {*a[2], *b[2]} if k[1] in rates]
    return sum(a[2].get(k) == b[2].get(k) for k in either) / max(len(either), 1)


def shown(print_):
    whole, first, parts = print_
    return f"{whole:016x}{first:02x}" + "".join(f"{parts.get((s, first + k), 0):04x}" for s in range(P.SEEDS) for k in range(P.SHOWN))


def test_fingerprints_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(P, "LOW", 0.05)
    monkeypatch.setattr(P.lexicon, "__defaults__", (0.05, 0.5))
    lexicon = {int(t) for t in P.lexicon(docs)}
    assert lexicon
    got = {r["doc_id"]: r for r in P.fingerprints_and_edits(docs).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)][1] or ""
        own, new, next_ = (brute_print(t, lexicon) for t in (text, text[: len(text) - len(text) // 3] + after[: len(text) // 3], after))
        row = got[r[0]]
        assert (row["fingerprint"], row["edited_fingerprint"]) == (shown(own), shown(new))
        assert row["near_edited"] == brute_likeness(own, new) and row["near_next"] == brute_likeness(own, next_)


def test_likeness_is_about_jaccard():
    rng = np.random.default_rng(3)
    for shared, apart in ((1000, 0), (900, 50), (500, 250), (10, 1000)):
        both, one, two = np.split(rng.integers(0, 2**63, shared + 2 * apart).astype(np.uint64), [shared, shared + apart])
        a, b = (P.printed(np.concatenate([both, x]), np.zeros(shared + apart, int), 1) for x in (one, two))
        assert abs(P.likeness(a, b)[0] - shared / (shared + 2 * apart)) < 0.2


def test_large_lexicons_take_the_other_way(docs, clash, rows, monkeypatch):
    want = P.lexicon(docs, 0.05, 0.5).tolist()
    plain = sorted(P.fingerprints_and_edits(docs).collect())
    alone = sorted(P.fingerprint_documents(docs).collect())
    monkeypatch.setattr(P, "MOST_TERMS", 3)
    table = P.lexicon(docs, 0.05, 0.5)
    assert sorted(r["term"] for r in table.collect()) == np.sort(np.array(want, np.uint64).view(np.int64)).tolist()
    assert sorted(P.fingerprints_and_edits(docs).collect()) == plain
    assert sorted(P.fingerprint_documents(docs).collect()) == alone


def test_fingerprints_of_odd_tables(spark, docs, clash, empty, rows):
    assert P.fingerprints_and_edits(empty).count() == 0
    assert P.fingerprints_and_edits(docs.filter("doc_id = 10")).count() == 1
    assert P.fingerprints_and_edits(clash.union(clash)).count() == 2 * len(rows)
    plain = {r["doc_id"]: r["fingerprint"] for r in P.fingerprint_documents(docs).collect()}
    assert plain == {r["doc_id"]: r["fingerprint"] for r in P.fingerprints_and_edits(docs).collect()}
    unnamed = docs.unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    assert P.fingerprints_and_edits(unnamed).filter("doc_id is null").count() == 2


def test_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v"))
    for n in (1, 2, 7, 50):
        cuts = cuts_of(df, "v", n)
        got = {r["v"]: r["p"] for r in df.select("v", range_of("v", cuts).alias("p")).collect()}
        assert all(p == sum(c < v for c in cuts) for v, p in got.items())


def brute_pipeline(rows, benchmark):
    """doc_ids that survive the first three stages, by plain means."""
    from tests.llm.test_near_duplicates import brute

    component = {i: c for i, (_, c) in brute(rows).items()}
    norm = lambda t: " ".join((t or "").lower().split())
    kept = [r for r in rows if component[r[0]] == r[0]]
    return {r[0] for r in kept if not any(norm(b) in norm(r[1]) for b in benchmark)}


def test_stages(spark, docs, rows, tmp_path):
    letters = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and r[2]]
    sub = docs.filter(F.col("doc_id").isin([r[0] for r in letters]))
    sub = sub.withColumn("text", F.when(F.col("doc_id") == letters[5][0], F.concat("text", F.lit(" token = abcdefgh12345678 end"))).otherwise(F.col("text")))
    letters[5] = (letters[5][0], letters[5][1] + " token = abcdefgh12345678 end", *letters[5][2:])
    passage = letters[8][1]
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sub.write.parquet(f"{tmp_path}/documents.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    frames = {}
    for name, apply in corpus_pipeline.STAGES:
        data = stage(apply(spark, data, str(tmp_path)), name)
        frames[name] = data
    first = {r["doc_id"] for r in frames["language_id"].collect()}
    assert len(first) >= len(letters) - 2  # plain prose stays
    want = brute_pipeline([r for r in letters if r[0] in first], [passage])
    redacted = {r["doc_id"]: r for r in frames["secret_scans"].collect()}
    assert set(redacted) == want and frames["secret_scans"].columns == pipeline.COLUMNS
    assert redacted[letters[5][0]]["text"].endswith(" [SECRET] end") and redacted[letters[5][0]]["n_chars"] == len(redacted[letters[5][0]]["text"])
    packed = data.toPandas()
    assert set(packed["doc_id"]) == want and (packed.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_rows_without_an_id_and_ids_of_several_texts(spark, rows, tmp_path):
    prose = [r for r in rows[:60]]
    odd = [(None, prose[0][1] + " and more words of its own here", "en", "s0", 1), (None, prose[1][1], "en", "s0", 1), (500, prose[2][1] + " x y z", "en", "s1", 1), (500, prose[3][1] * 2, "en", "s1", 1), (500, prose[3][1] * 2, "en", "s1", 1), (None, None, None, None, None)]
    table = [(r[0], r[1], "en", "s1", r[4]) for r in prose] + odd
    spark.createDataFrame([(1, "none of the documents holds this passage, as it has quite other words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    data = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, apply in pipeline.STAGES[:4]:
        data = stage(apply(spark, data, str(tmp_path)), name)
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in data.collect() if r["text"])
    sets = brute_sets(table)
    assert texts == sorted((-1 if i is None else i, t) for i, t in sets if t)


def brute_sets(table):
    """(doc_id, text) of one row of each group of near duplicates: the least id, rows without one last."""
    from tests.llm.test_near_duplicates import brute

    distinct = list(dict.fromkeys((r[0], r[1]) for r in table))
    component = brute([(k, t) for k, (_, t) in enumerate(distinct)])
    groups = collections.defaultdict(list)
    for k, (i, t) in enumerate(distinct):
        groups[component[k][1]].append((i is None, i or 0, k))
    return [distinct[min(g)[2]] for g in groups.values()]


def test_stages_of_an_empty_table(spark, empty, tmp_path):
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
