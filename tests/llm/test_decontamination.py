import random

import numpy as np

from recordloom.llm import decontamination as D
from tests.llm.conftest import prose


def items_of(n=12, seed=9):
    rng = random.Random(seed)
    return [(100 + k, prose(rng, rng.randint(18, 60))) for k in range(n)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_exact_and_edited_passages():
    items, rng = items_of(), random.Random(2)
    block = D.Items(items)
    texts = [prose(rng, 80) + f"\n{t.upper()}\t " + prose(rng, 50) for _, t in items]
    assert {(r[0], r[1]) for r in D.search(texts, block)} == {(k, k) for k in range(len(items))}
    changed = []
    for _, t in items:
        c = list(t)
        for at in range(10, len(c), 60):
            c[at] = "#"
        changed.append(prose(rng, 30) + " " + "".join(c))
    assert {(r[0], r[1]) for r in D.search(changed, block)} == {(k, k) for k in range(len(items))}


def test_clean_texts_are_left_alone():
    rng = random.Random(77)
    assert D.search([prose(rng, 300) for _ in range(60)] + ["", " "], D.Items(items_of())) == []


def test_windows_against_brute_force():
    """Every window within its budget of some region of the text is found, and nothing beyond the budget is."""
    rng = random.Random(4)
    item = prose(rng, 14)[:96]
    block = D.Items([(1, item)])
    for trial in range(40):
        c = list(D.normal(item))
        for _ in range(trial % 12):
            at = rng.randrange(len(c))
            c[at : at + 1] = rng.choice([[], [rng.choice("xyz")], [c[at], "q"]])
        text = "zz " * (trial % 5) + "".join(c) + " yy"
        found = D.search([text], block)
        whole = D.normal(item)
        cost = min(edits(whole, D.normal(text)[a : a + len(whole) + d]) for a in range(0, 20) for d in range(-14, 15))
        budget = int(len(whole) * D.EDITS)
        if cost <= budget:
            assert found, (trial, cost)
        if not found:
            assert cost > budget
        if found:
            assert found[0][5] <= budget


def test_banded_alignment_against_full_table():
    rng = random.Random(8)
    for _ in range(30):
        a = "".join(rng.choice("ab") for _ in range(12))
        text = "".join(rng.choice("ab") for _ in range(20))
        begin, end = np.array([3, 3]), np.array([23, 23])
        points = D.points_of("ab\0" + text + "\0ab")
        want = min(edits(a, text[i:j]) for i in range(21) for j in range(i, 21))
        windows = np.stack([D.points_of(a)] * 2)
        assert D.banded(points, begin, end, np.array([-20, -20]), 60, windows, np.array([12, 12]), 12).tolist() == [want, want]
        assert D.banded(points, begin, end, np.array([-20, -20]), 60, windows, np.array([12, 12]), 1).tolist() == [min(want, 2)] * 2


def test_recall_of_replaced_words():
    """Items with a tenth of their words replaced: nine tenths and more are found."""
    rng = random.Random(31)
    items = [(k, prose(rng, rng.randint(30, 60))) for k in range(200)]
    block, vocabulary = D.Items(items), prose(rng, 2000).split()
    texts = []
    for _, t in items:
        words = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in t.split()]
        texts.append(f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}")
    found = {(r[0], r[1]) for r in D.search(texts, block)}
    assert sum((k, k) in found for k in range(200)) >= 180


def test_slices_do_not_change_results(monkeypatch):
    rng = random.Random(5)
    item = prose(rng, 50)
    items = D.Items([(1, item), (2, item + " " + item), (3, prose(rng, 40))])
    texts = [" ".join([prose(rng, 5), item] * 40), "", prose(rng, 400), item]
    want = D.search(texts, items)
    assert {(r[0], r[1]) for r in want} >= {(0, 0), (0, 1), (3, 0)}
    monkeypatch.setattr(D, "SLICE", 50)
    assert D.search(texts, items) == want


def test_keys_that_share_a_slot():
    items = D.Items(items_of())
    points = np.random.default_rng(1).choice(items.keys, 500)
    near = np.concatenate([points, points + np.uint64(1), points - np.uint64(1)])
    items.bits, items.slots = 4, np.full(16, -1, np.int32)
    items.slots[(items.keys >> np.uint64(60))[::-1]] = np.arange(len(items.keys) - 1, -1, -1)
    at, key = items.found(near)
    want = np.flatnonzero(np.isin(near, items.keys))
    assert at.tolist() == want.tolist() and (items.keys[key] == near[want]).all()


def test_tables(spark, docs, clash, empty, rows):
    long = max((r for r in rows if r[1]), key=lambda r: len(r[1]))
    items = spark.createDataFrame([(1, long[1][40_000:40_300]), (2, None), (3, "ab"), (4, "no such passage in any of the documents here at all, quite certainly none of this kind")], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()} == {(long[0], 1)}
    assert D.decontaminate(clash, items).count() == len(rows) - 1 and D.decontaminate(clash, items).columns == clash.columns
    assert D.contaminated(empty, items).count() == 0 and D.contaminated(docs, items.limit(0)).count() == 0
    assert D.contaminated(docs.union(docs), items).count() == 2


def test_blocks_of_items(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 200)
    texts = [r for r in rows[:6]]
    items = spark.createDataFrame([(k, r[1]) for k, r in enumerate(texts)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in D.contaminated(docs, items).collect()}
    assert {(r[0], k) for k, r in enumerate(texts)} <= found


def test_long_quotes_of_long_items_and_changed_words():
    rng = random.Random(8)
    item = prose(rng, 300)
    words = item.split()
    texts = [prose(rng, 60) + " " + " ".join(words[90:210]) + " " + prose(rng, 60), prose(rng, 60) + " " + " ".join(words[90:110])]
    assert [r[:2] for r in D.search(texts, D.Items([(1, item)]))] == [(0, 0)]
    items = [(k, prose(rng, 40)) for k in range(60)]
    changed = []
    for _, text in items:
        some = text.split()
        for at in rng.sample(range(40), 4):
            some[at] = rng.choice("zebra yonder quick violet".split())
        changed.append(prose(rng, 20) + " " + " ".join(some))
    assert len({r[:2] for r in D.search(changed, D.Items(items))} & {(k, k) for k in range(60)}) >= 54
