import numpy as np
import pyarrow as pa

from recordloom.llm import near_duplicates as N
from recordloom.llm.textblocks import split_words


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")
    words = [w for part in words for w in part.split("\t") for w in w.split("\n") if w]
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {r[0]: shingles(r[1]) for r in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_against_brute_force(docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_kept_is_one_of_each_component(docs):
    out = N.near_duplicates(docs).toPandas()
    assert (out["kept"] == (out["doc_id"] == out["component_id"])).all()
    assert out.groupby("component_id")["kept"].sum().eq(1).all()


def test_blocks_of_a_large_group(spark, monkeypatch):
    """With tiny blocks every member still finds its links."""
    monkeypatch.setattr(N, "STAR_BLOCK", 2)
    monkeypatch.setattr(N, "BUCKET_BLOCK", 3)
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(30):
        base[rng.integers(60)] = f"e{k}"
        rows.append((k, " ".join(base)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in N.near_duplicates(docs).collect()} == brute(rows)


def test_every_coordinate_fills_and_estimates():
    a, b = " ".join(f"a{k}" for k in range(400)), " ".join(f"a{k}" for k in range(100, 500))
    values, starts = N.shingle_sets(split_words(pa.array([a, b, "x", "", None])))
    table = N.sketches(values, starts)
    assert (table[:3] != N.EMPTY).all() and (table[3:] == N.EMPTY).all()
    x, y = set(values[starts[0] : starts[1]].tolist()), set(values[starts[1] : starts[2]].tolist())
    assert abs((table[0] == table[1]).mean() - len(x & y) / len(x | y)) < 0.12


def test_odd_tables(spark, docs, clash, empty, rows):
    assert N.near_duplicates(empty).count() == 0
    got = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(clash.union(clash)).collect()}
    assert got == {i: c for i, (_, c) in brute(rows).items()}
    none = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    assert sorted((tuple(r)[:4] for r in N.near_duplicates(none).collect()), key=str) == [(1, 0, 1, True), (None, 2, None, True)]
    again = spark.createDataFrame([(1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "p q r s t u v")], "doc_id long, text string")
    assert len(N.near_duplicates(again).collect()) == 4


def test_one_large_class_and_one_large_component(spark):
    """100,000 rows: copies of one text, versions of another, and odd ones; everything lands in its group."""
    base = [f"w{k}" for k in range(40)]
    text = lambda k: " ".join(base) if k % 50 else " ".join(base[:20] + [f"v{k}"] + base[20:]) if k % 100 else f"alone {k} " * 3
    docs = spark.createDataFrame([(k, text(k)) for k in range(100_000)], "doc_id long, text string")
    counts = {r["component_id"]: r["count"] for r in N.near_duplicates(docs).groupBy("component_id").count().collect()}
    assert counts == {1: 99_000} | {100 * k: 1 for k in range(1000)}
