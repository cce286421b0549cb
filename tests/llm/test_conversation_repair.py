import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from recordloom.llm import conversation_repair as C

SPACES = " \t\n\x0b\x0c\r"
NEXT = {0: "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        c = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if c == 1:
            text = ""
        if c == 2:
            text = "".join(x for x in text if x not in ".!?")
        if c == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(c, 1)
    return out


def brute(rows, costs=C.Costs()):
    """What the contract asks of one conversation's (turn, role, text), by trying every edit in every state."""
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest())
    rows = sorted(rows, key=order)
    faults, seen = [], set()
    for _, role, text in rows:
        said = text.strip(SPACES)
        faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserted=0):
        found = []
        if inserted < 3 and state != "end":
            role = NEXT[state]
            found.append((costs.insert, "I", (("user" if role == "u" else "assistant") + ":",), i, role, inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            found.append((costs.delete, "D", (), i + 1, state, 0))
            if faults[i] in ("", "truncated"):
                stay = costs.truncated if faults[i] else 0
                if role[:1] == NEXT[state] or state == 0 and role[:1] == "s":
                    found.append((stay, "K", (f"{role}:{text}",), i + 1, role[:1], 0))
                new = "user" if NEXT[state] == "u" else "assistant"
                found.append((stay + costs.rerole, "R", (f"{new}:{text}",), i + 1, new[0], 0))
        results = [(0, "", ())] if i == len(rows) and state in (0, "a") else []
        for cost, letter, text, *after in found:
            if (rest := best(*after)) is not None:
                results.append((cost + rest[0], letter + rest[1], text + rest[2]))
        return min(results, default=None, key=lambda r: r[:2])

    cost, audit, kept = best(0, 0)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    count = lambda f: faults.count(f)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())


def conversations(seed, n, longest=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        turns = rng.randint(0, longest)
        for t in range(turns):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "s", "under"])
            text = rng.choice([f"text {rng.randint(0, 99)}.", f"cut {rng.randint(0, 99)}", "same!", "same!", "", None, " \t", "ends?  \n"])
            rows += [(conv, rng.choice([t, t, t, 2 * t, None, 0]), role, text)] * rng.choice([1, 1, 1, 1, 2])
    return rows


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def held(frame):
    got = frame.collect()
    out = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got}
    assert len(out) == len(got)
    return out


@pytest.mark.parametrize("block", [C.BLOCK, 2, 3])
def test_against_brute_force(spark, block):
    rows = conversations(block, 300) + [(None, 1, "user", "hello."), (None, 2, "assistant", "there")]
    by = {}
    for conv, *r in damaged(rows):
        by.setdefault(conv, []).append(tuple(r))
    want = {conv: brute(by.get(conv, [])) for conv in {r[0] for r in rows}}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = held(C.digest(C.damage(frame), frame, block=block))
    assert got == want


def test_inserts_and_other_costs():
    rng = random.Random(7)
    for n in range(400):
        costs = C.Costs(rerole=rng.randint(0, 4), delete=rng.randint(0, 6), insert=rng.randint(1, 3), truncated=rng.randint(0, 3))
        letters = "".join(rng.choice("ACDFGIJLB") for _ in range(rng.randint(0, 7)))
        roles = {0: "s", 1: "u", 2: "a", 3: "x"}
        rows = []
        for k, c in enumerate(letters):
            initial, fault = divmod(C.LETTERS.index(c), 3)
            rows.append((k, roles[initial], "" if fault == C.GONE else f"t{k}" + ("" if fault == C.TRUNCATED else ".")))
        ends = {s: costs.insert * len(C.LAST[s]) for s in C.LAST}
        cost, edits = C.solve(letters, [C.START], ends, costs, True)[C.START]
        want = brute(rows, costs)
        assert (cost, C.audit_of(edits)) == (want[5], want[6]), (letters, costs)


def test_repaired_turns(spark):
    rows = conversations(11, 120)
    frame = spark.createDataFrame(rows, SCHEMA)
    out = C.repair(frame).collect()
    kept = {}
    for r in out:
        if r["edit"] == "D":
            assert r["text"] is None
        elif r["edit"] == "R":
            assert r["role"] in ("user", "assistant")
        kept.setdefault(r["conv_id"], []).append(r)
    assert sum(r["n"] for r in out) == len(rows)


def test_long_conversation_in_blocks(spark):
    """One conversation over many blocks and ranges, against one block."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"turn {t}" + rng.choice([".", ".", ""])) for t in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert held(C.digest(frame, frame, block=64)) == held(C.digest(frame.coalesce(1), frame, block=5000))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.digest(C.damage(empty), empty).count() == 0 and C.repair(empty).count() == 0
    rows = [(1, 1, "user", "x" * 300_000 + "."), (1, 2, "assistant", "y.")]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("_conv", "sha", "n", "edit", "block", "kind")})
    got = held(C.digest(frame, frame))
    assert got[1][5:7] == (0, "KK")
