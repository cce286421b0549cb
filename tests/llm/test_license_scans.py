import random
import re

import pytest

from recordloom.llm import license_scans as L

MIT = next(t.text for t in L.TEMPLATES if t.label == "mit" and t.k == L.LONG)
APACHE = next(t.text for t in L.TEMPLATES if t.label == "apache" and t.k == L.LONG)


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, templates=L.TEMPLATES):
    """(n_words, n_base, first, last, base labels, labels, score), place by place."""
    w, starts, base, labels, score = words(text), [], set(), set(), 0.0
    for t in templates:
        if t.k == L.SHORT:
            at = [i for i in range(len(w)) if w[i : i + len(t.words)] == t.words]
            if at:
                labels.add(t.label)
                score = 1.0
            if t.base and at:
                starts += at
                base.add(t.label)
            continue
        places = [(tuple(t.words[j : j + t.k]), j) for j in range(len(t.words) - t.k + 1)]
        known = {g for g, _ in places}
        hits = [(i - j, j) for i in range(len(w) - t.k + 1) if (g := tuple(w[i : i + t.k])) in known for h, j in places if g == h]
        for d in {d for d, _ in hits}:
            covered = {j + x for e, j in hits if abs(d - e) <= L.SHIFT for x in range(t.k)}
            score = max(score, len(covered) / len(t.words))
            if len(covered) / len(t.words) >= L.COVERED:
                labels.add(t.label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def changed(rng, text, share):
    out = []
    for w in text.split():
        x = rng.random()
        out += ["changed"] if x < share / 3 else [] if x < 2 * share / 3 else [w, "more"] if x < share else [w]
    return " ".join(out)


@pytest.fixture(scope="module")
def texts(rows):
    rng = random.Random(2)
    own = [MIT.title() + "!", "x " * 40 + changed(rng, MIT, 0.05) + " y" * 9, changed(rng, APACHE, 0.08), changed(rng, APACHE, 0.6), MIT[: len(MIT) // 4], "MIT-License, mit\nlicense; MIT License. " * 30]
    own += ["The MIT LİCENSE and the MIT license", "general public licence", "general public license general public license", "mit", "license mit", "émit license", "CC BY-NC 4.0", "K mit licenseK"]
    return own + [r[1] for r in rows]


def test_against_brute_force(spark, texts):
    got = L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3))
    found = {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) for r in got.collect()}
    assert found == {n: brute(t) for n, t in enumerate(texts)}
    assert found[0][5] == found[1][5] == "mit" and "apache" in found[2][5] and found[4][5] == ""
    assert found[5][1] == 90


def test_spans(spark, texts):
    got = {(r["doc_id"], r["label"], r["start"]): r["covered"] for r in L.license_spans(spark.createDataFrame(list(enumerate(texts[:9])), "doc_id long, text string")).collect()}
    assert got[(0, "mit", 0)] == 1.0
    assert [k for k in got if k[0] == 1] == [(1, "mit", k[2]) for k in got if k[0] == 1] and any(36 <= k[2] <= 44 for k in got if k[0] == 1)


def test_odd_tables(clash, empty, docs, rows):
    out = L.scan_licenses(clash)
    assert out.count() == len(rows) and "rep" in out.columns
    assert L.scan_licenses(empty).count() == 0
    assert L.scan_licenses(docs.union(docs)).count() == 2 * len(rows)


def test_no_python_in_the_plan(docs):
    plans = [L.scan_licenses(docs), L.votes(docs)]
    assert not any(x in p._jdf.queryExecution().executedPlan().toString() for p in plans for x in ("Python", "Pandas", "Arrow"))
