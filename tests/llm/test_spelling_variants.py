import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from recordloom.llm import spelling_variants as S


def runs(rows):
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{low}".encode())
            yield low[: h % len(low)] + low[h % len(low) + 1 :] if h % 97 == 0 else low


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts):
    """{word: (form, root, n, n_near, form_n)}, every word against every other."""
    near = {w: [x for x in counts if x != w and abs(len(x) - len(w)) <= 1 and distance(w, x) == 1] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), form[w] and counts[form[w]])
    return out


def held(frame):
    got = frame.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    pool = ["".join(rng.choice("abéA") for _ in range(rng.randint(4, 8))) for _ in range(150)] + ["Straße", "ÀÉÎÕÜ", "naïves", "mother×son"]
    text = lambda: " ".join(rng.choice(pool) + rng.choice(["", ",", "1", "'s"]) for _ in range(rng.randint(0, 300)))
    rows = [(k if k % 7 else None, text()) for k in range(40)] + [(90, None), (91, ""), (92, "ß" * 20_000 + " " + "ß" * 19_999), (93, "ß" * 20_000), (93, "ß" * 20_000), (94, ("ß" * 19_999 + " ") * 2)]
    rows.append((95, "stones " * 60 + "stonez " * 20 + "ztonez " * 6))
    return rows + rows[:3]


def test_against_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(S, "AT_ONCE", 40)
    counts = {w: n for w, n in Counter(runs(texts)).items() if len(w) >= 5 and n >= 3}
    short = {w: n for w, n in counts.items() if len(w) < 100}
    want = brute(short)
    long = sorted((w for w in counts if len(w) >= 100), key=len)
    got = held(S.spelling_variants(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)))
    assert {w: r for w, r in got.items() if len(w) < 100} == want
    assert [len(w) for w in long] == [len(w) for w in sorted(got, key=len) if len(w) >= 100]
    assert all(got[w][3] == sum(abs(len(w) - len(x)) == 1 for x in long) for w in long)
    assert sum(r[3] for r in want.values()) > 100 and any(r[1] != r[0] and r[0] for r in want.values())


def test_few_words_a_shard(spark, texts, monkeypatch):
    """Hot edges over several shards, and the pairs once each."""
    monkeypatch.setattr(S, "SHARD", 5)
    monkeypatch.setattr(S, "SEGMENTS", 20)
    counts = {w: n for w, n in Counter(runs(texts)).items() if 5 <= len(w) < 100}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r["word"], r["near"], r["n"], r["near_n"]) for r in S.near_words(frame).collect()]
    assert len(pairs) == len(set(pairs))
    assert {p[:2] for p in pairs} == {(a, b) for a in counts for b in counts if a != b and abs(len(a) - len(b)) <= 1 and distance(a, b) == 1}
    assert all(counts[a] == n and counts[b] == m for a, b, n, m in pairs)


def test_one_edit():
    rng = np.random.default_rng(1)
    for n, m in ((5, 5), (6, 5), (5, 6)):
        a, b = (rng.integers(0, 2, (400, k)).astype(np.uint32) for k in (n, m))
        near, _ = S._one_edit(a, b)
        assert near.tolist() == [distance(x, y) == 1 for x, y in zip(a.tolist(), b.tolist(), strict=True)]


def test_long_chain_of_forms(spark):
    links = [(f"w{k:03}", f"w{k + 1:03}") for k in range(100)]
    got = {r["word"]: r["root"] for r in S.follow(spark.createDataFrame(links, "word string, form string")).collect()}
    assert got == {a: "w100" for a, _ in links}


def test_odd_tables(spark, clash, empty, docs):
    assert S.spelling_variants(empty).count() == 0
    assert held(S.spelling_variants(clash)) == held(S.spelling_variants(docs))
    once, twice = ({r["word"]: r["n"] for r in S.word_counts(x).collect()} for x in (docs, docs.union(docs)))
    assert all(twice[w] == 2 * n for w, n in once.items())
