import collections
import math
import zlib

import numpy as np

from recordloom.llm import language_model as L


def words(text):
    out = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        out = out.replace(c, " ")
    return [w for w in out.split(" ") if w] + [None]


def test_base_against_brute_force(docs, rows):
    got = {r["doc_id"]: r for r in L.score(docs).collect()}
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 7 != 2:
            counts.update(words(r[1]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine, row = words(r[1]), got[r[0]]
        assert row["train_tokens"] == n and row["n_tokens"] == len(mine) and row["n_known"] == sum(counts[w] > 0 for w in mine)
        assert row["held_out"] == (zlib.crc32(str(r[0]).encode()) % 7 == 2)
        assert math.isclose(row["base_score"], sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in mine), rel_tol=1e-9)


def test_model_beats_base_on_held_out(docs):
    out = L.score(docs).toPandas()
    held = out[out["held_out"] & (out["n_tokens"] > 20)]
    assert held["score"].sum() > held["base_score"].sum()


def brute_score(rows, weights):
    """log10 probability of each row's text by counting n-grams of all other training rows."""
    train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    grams = []
    for r in rows:
        w = words(r[1])
        two = list(zip([None, *w[:-1]], w, strict=True))
        grams.append((collections.Counter(w), collections.Counter(two), collections.Counter(zip([None, *w[:-2]], w[:-1], w[1:], strict=True) if len(w) > 1 else [])))
    total = [collections.Counter() for _ in range(3)]
    for r, g in zip(rows, grams, strict=True):
        if train(r[0]):
            for t, c in zip(total, g, strict=True):
                t.update(c)
    v, out = len(total[0]), {}
    for r, g in zip(rows, grams, strict=True):
        count = lambda k, x, g=g, r=r: total[k][x] - (g[k][x] if train(r[0]) else 0)
        n = sum(total[0].values()) - (sum(g[0].values()) if train(r[0]) else 0)
        w, sum_ = words(r[1]), 0.0
        for t, x in enumerate(w):
            before = None if t == 0 else w[t - 1]
            ctx, bi = count(0, before), count(1, (before, x))
            ctx2, tri = (ctx, bi) if t == 0 else (count(1, (None if t == 1 else w[t - 2], before)), count(2, (None if t == 1 else w[t - 2], before, x)))
            b = L.EACH + 1 + min(ctx2.bit_length() - 1, L.EACH - 1) if ctx2 else 1 + min((ctx.bit_length() - 1) // 2, L.EACH - 1) if ctx else 0
            sum_ += math.log10(np.dot(weights[b], [1 / (v + 1), count(0, x) / max(n, 1), bi / max(ctx, 1), tri / max(ctx2, 1)]))
        out[r[0]] = sum_
    return out


def test_score_against_brute_force(docs, rows, monkeypatch):
    fitted, kept = L.learned, []
    monkeypatch.setattr(L, "learned", lambda *a: kept.append(fitted(*a)) or kept[0])
    got = {r["doc_id"]: r["score"] for r in L.score(docs).collect()}
    want = brute_score(rows, kept[0])
    assert all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in want)


def test_copies_score_apart(spark):
    """A text that occurs once more anywhere scores far above one that doesn't, in training or held out."""
    import random

    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 40)}" if rng.random() < 0.7 else f"x{rng.random()}" for _ in range(60))
    rows = [(k, text()) for k in range(300)]
    rows += [(1000 + k, rows[k][1]) for k in range(30)]
    out = L.score(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    each = out["score"] / out["n_tokens"]
    trained = [k for k in range(30) if not (out["held_out"][k] or out["held_out"][1000 + k])]
    most = np.quantile([each[k] for k in range(30, 300)], 0.9)
    assert len(trained) > 10 and np.mean([each[k] > most for k in trained]) >= 0.9


def test_probabilities_sum_to_one():
    """Over the vocabulary and one unseen token, for any seen context."""
    counts, context, pairs = np.array([5, 3, 2]), np.array([2, 0, 1]), np.array([1, 0, 1])
    v, n, w = 3, 10, np.array([0.2, 0.4, 0.3, 0.1])
    assert math.isclose((w[0] / (v + 1) + w[1] * counts / n + w[2] * context / 3 + w[3] * pairs / 2).sum() + w[0] / (v + 1), 1)


def test_weights_follow_the_data():
    zero = L.GRID - 1
    cell = lambda b, u, d, t: ((b * L.GRID + u) * L.GRID + d) * L.GRID + t
    w = L.learned(np.array([cell(3, 20, 1, zero), cell(4, 4, zero, zero), cell(L.EACH + 1, 20, 20, 0)]), np.array([1000.0] * 3), 10_000)
    assert w[3, 2] > 0.9 and w[4, 1] > 0.9 and w[L.EACH + 1, 3] > 0.9 and np.allclose(w.sum(axis=1), 1) and not w[0, 2:].any() and not w[4, 3]
    assert L.bucket(np.array([0, 0, 0, 1, 2, 3, 10**6]), np.array([0, 1, 16, 1, 9, 9, 10**6])).tolist() == [0, 1, 3, 9, 10, 10, 16]


def test_byte_planes_round_trip():
    x = np.unique(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2))
    assert (L.unpacked(L.packed(x)) == x).all() and L.unpacked(L.packed(x[:0])).size == 0
    assert (L.grown(L.small(np.arange(300))) == np.arange(300)).all()


def test_small_blocks_give_the_same(docs, monkeypatch):
    one = {r["doc_id"]: (r["base_score"], r["score"]) for r in L.score(docs).collect()}
    monkeypatch.setattr(L, "BLOCK_BYTES", 3000)
    other = {r["doc_id"]: (r["base_score"], r["score"]) for r in L.score(docs).collect()}
    assert all(math.isclose(one[k][j], other[k][j], rel_tol=1e-9) for k in one for j in (0, 1))


def test_odd_tables(docs, clash, empty, rows):
    assert L.score(empty).count() == 0
    assert L.score(clash.union(clash)).count() == 2 * len(rows)
    lone = docs.filter("doc_id = 10")
    assert all(np.isfinite(r["score"]) for r in L.score(lone).collect())
