"""Conversation structure repair by a retained-subsequence dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``. The program chooses which turns stay, kept or reroled; what
lies between two retained turns is deleted, at the difference of two prefix sums, and the pair of their roles says how
many empty turns go between them. So the best way on from a turn is, for each role of the next retained turn, a running
minimum over the turns after it. Of equally cheap ways the one whose audit is least in ASCII is taken: D < I < K < R, so
the longest gap comes first, then the most inserts, then Keep.

Scale: the program needs a class letter for each distinct turn of a conversation, not its text. Turns are dealt by ranges
and cut into blocks of BLOCK; each block is solved for all roles it may be entered and left with (the first only from the
start, the last only to the end), and one row of numbers for each block is enough to choose the way through a
conversation. Identical turns are counted, not listed. Texts move once, with their edits; in ``digest`` once by
conversation, because a SHA-256 over all of it can only be taken in order: that is a stream of constant memory.

Null roles and texts are one space; rows without a conversation id are one conversation; null turns come first, turns of
one number go by role and SHA-256 of the text; repeated rows are duplicates; very long texts are only measured and hashed;
an empty table gives none. Other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.staging import look_up, stage


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  #: of a truncated turn that stays


#: Distinct turns of a conversation that one task solves at once.
BLOCK = 50_000
FAR = 1 << 60
#: States: the role of the turn retained last, or none yet; and having reached the end.
START, S, U, A, END = range(5)
INITIAL = {"s": S, "u": U, "a": A}
ROLE = {U: "user", A: "assistant"}
#: The roles to insert between two retained turns; a pair that isn't here can't be.
BETWEEN = {(START, S): (), (START, U): (), (START, A): (U,), (S, U): (), (S, A): (U,), (U, A): (), (U, U): (A,), (A, U): (), (A, A): (U,)}
LAST = {START: (), S: (U, A), U: (A,), A: ()}
CLEAN, GONE, TRUNCATED = range(3)
LETTERS = "ABCDEFGHIJKL"  # initial (s, u, a, other) x fault
SPACE = " \t\n\x0b\x0c\r"
SOLVED = (
    "_conv string, _p int, block int, turns array<struct<turn: bigint, role: string, sha: string, n: bigint, fault: string, letter: string>>, "
    "entries array<struct<came: int, left: int, cost: bigint, rank: int, edits: string>>"
)
MARK = {U: "u", A: "a"}  # a retained turn's new role in an entry's edits; inserts are in upper case before it


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the contract's damage, by the CRC-32 of ``conv_id:turn``; nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    drawn = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("c"))
    text = F.when(F.col("c") == 1, "").when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("c") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("c") == 0, 0).when(F.col("c") == 3, 2).otherwise(1)
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(1), times))).drop("col")


def _keyed(rows: DataFrame) -> DataFrame:
    """(_conv, turn, role, text, sha) with no nulls but in turn."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select(_conv(), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("sha"))


def _conv() -> Column:
    return F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")).alias("_conv")


def _turns(keyed: DataFrame) -> DataFrame:
    """(_conv, turn, role, sha, n, fault, letter): every distinct turn, how often it is there, and the first one's fault."""
    said = F.rtrim("text", F.lit(SPACE))
    fault = F.when(said == "", "blank").when(F.right(said, F.lit(1)).isin(".", "!", "?"), "").otherwise("truncated")
    distinct = keyed.withColumn("fault", fault).groupBy("_conv", "turn", "role", "sha").agg(F.count(F.lit(1)).alias("n"), F.min("fault").alias("fault"))
    distinct = stage(distinct, "turns")
    order = F.struct(F.col("turn").isNotNull().alias("there"), F.coalesce("turn", F.lit(0)).alias("turn"))
    again = distinct.filter("fault <> 'blank'").groupBy("_conv", "role", "sha").agg(F.count(F.lit(1)).alias("c"), F.min(order).alias("_first")).filter("c > 1").drop("c")
    seen = look_up(distinct, again, ["_conv", "role", "sha"], F.coalesce("turn", F.lit(-1)))
    seen = seen.withColumn("fault", F.when(F.col("_first").isNotNull() & (order != F.col("_first")) & (F.col("fault") != "blank"), "duplicate").otherwise(F.col("fault"))).drop("_first")
    initial = F.substr("role", F.lit(1), F.lit(1))
    which = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) * 3 + F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault") == "", CLEAN).otherwise(GONE)
    return seen.withColumn("letter", F.substr(F.lit(LETTERS), which + 1, F.lit(1)))


def solve(letters: str, came: list[int], ends: dict[int, int], costs: Costs, last: bool) -> dict[int, tuple[int, list[str]]]:
    """For each state of ``came`` the cheapest (cost, edits) through turns of these classes. ``ends`` gives the cost of
    leaving in each state; at the ``last`` block leaving means to insert what the end needs. An edit is the roles to
    insert before the turn in upper case, and D, K, or u or a for a new role; the last item has inserts at the end."""
    n = len(letters)
    gone = [costs.delete * i for i in range(n + 1)]  # prefix sums; turns may be weighted
    best = {S: (FAR, n, ""), U: (FAR, n, ""), A: (FAR, n, "")}  # running minima: cost with the prefix sum, turn, edit
    ways: list[dict[int, tuple]] = [{}] * n

    def on(at: int, state: int) -> tuple[int, tuple]:
        """The cheapest way on after turn ``at`` - 1, and how: (next turn, its role, its edit, roles to insert)."""
        tail = ends.get(state, FAR)
        cost, rank, how = gone[n] - gone[at] + tail, (-n, 0, 0), (n, END, "", LAST[state] if last else ())
        for role, (value, k, edit) in best.items():
            if value < FAR and (put := BETWEEN.get((state, role))) is not None:
                c, r = value - gone[at] + costs.insert * len(put), (-k, -len(put), edit != "K")
                if c < cost or c == cost and r < rank:
                    cost, rank, how = c, r, (k, role, edit, put)
        return cost, how

    for k in range(n - 1, -1, -1):
        initial, fault = divmod(LETTERS.index(letters[k]), 3)
        if fault == GONE:
            continue
        after = {role: on(k + 1, role) for role in ((S, U, A) if initial == 0 else (U, A))}
        ways[k] = {role: how for role, (_, how) in after.items()}
        stay = costs.truncated if fault == TRUNCATED else 0
        for role, (cost, _) in after.items():
            kept = initial < 3 and role == (S, U, A)[initial]
            if role == S and not kept or cost >= FAR:
                continue
            value = cost + stay + gone[k] + (0 if kept else costs.rerole)
            if value < best[role][0]:  # of equal ones the later turn stays: more deletes come first
                best[role] = (value, k, "K" if kept else MARK[role])
    found = {}
    for state in came:
        cost, how = on(0, state)
        if cost >= FAR:
            continue
        edits = ["D"] * n + [""]
        while True:
            k, role, edit, put = how
            edits[k] = "".join(MARK[p].upper() for p in put) + edit
            if role == END:
                break
            how = ways[k][role]
        found[state] = (cost, edits)
    return found


def audit_of(edits: list[str]) -> str:
    """The audit's letters of edits as solve() gives them, repeated turns left out."""
    return "".join("I" * (len(e) - 1) + ("R" if e[-1] in "ua" else e[-1]) if e and e[-1] in "DKua" else "I" * len(e) for e in edits)


def _solved(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("came", pa.int32()), ("left", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))
    for batch in batches:
        out = []
        for letters, first, last in zip(batch["letters"].to_pylist(), batch["first"].to_pylist(), batch["last"].to_pylist(), strict=True):
            came, entries = [START] if first else [START, S, U, A], []
            leave = [(END, {s: costs.insert * len(LAST[s]) for s in LAST})] if last else [(s, {s: 0}) for s in (START, S, U, A)]
            for left, ends in leave:
                for state, (cost, edits) in solve(letters, came, ends, costs, last).items():
                    entries.append({"came": state, "left": left, "cost": cost, "rank": 0, "edits": " ".join(edits), "audit": audit_of(edits)})
            for state in came:  # ways out of one state, by audit
                for rank, e in enumerate(sorted((e for e in entries if e["came"] == state), key=lambda e: e["audit"])):
                    e["rank"] = rank
            out.append([{k: v for k, v in e.items() if k != "audit"} for e in entries])
        names = ["_conv", "_p", "block", "turns"]
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], pa.array(out, kind)], [*names, "entries"])


def way_through(blocks: list[list[dict]]) -> list[int]:
    """Which entry of each block the cheapest way takes; of equal ones that with the least audit."""
    value, choices = {END: 0}, []
    for entries in reversed(blocks):
        best: dict[int, tuple] = {}
        for i, e in enumerate(entries):
            if e["left"] in value:
                c = (e["cost"] + value[e["left"]], e["rank"], i)
                best[e["came"]] = min(best.get(e["came"], c), c)
        choices.append({state: c[2] for state, c in best.items()})
        value = {state: c[0] for state, c in best.items()}
    state, picks = START, []
    for entries, chosen in zip(blocks, reversed(choices), strict=True):
        picks.append(chosen[state])
        state = entries[picks[-1]]["left"]
    return picks


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("_p", pa.int32()), ("block", pa.int32()), ("pick", pa.int32())]))
    for batch in batches:
        picks = [[{"_p": b["_p"], "block": b["block"], "pick": k} for b, k in zip(blocks, way_through([b["entries"] for b in blocks]), strict=True)] for blocks in batch["blocks"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["_conv"], pa.array(picks, kind)], ["_conv", "picks"])


def plan_edits(keyed: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """(_conv, turn, role, sha, n, fault, edit): the edit of every distinct turn, for its first row; the others of ``n``
    are deleted. ``edit`` holds the roles to insert before it in upper case, then D, K, or u or a for a new role; what
    is to be inserted at the end follows behind a slash."""
    spark = keyed.sparkSession
    order = ["turn", "role", "sha"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(_turns(keyed).repartitionByRange(n, "_conv", *order).withColumn("_p", F.spark_partition_id()), "ranged")
    nth = F.row_number().over(Window.partitionBy("_conv", "_p").orderBy(*order)) - 1
    cut = ranged.withColumn("nth", nth).withColumn("block", F.floor(F.col("nth") / block).cast("int"))
    blocks = cut.groupBy("_conv", "_p", "block").agg(F.array_sort(F.collect_list(F.struct("nth", F.struct("turn", "role", "sha", "n", "fault", "letter").alias("t")))).alias("held"))
    blocks = blocks.select("_conv", "_p", "block", F.transform("held", lambda x: x["t"]).alias("turns"))
    among = Window.partitionBy("_conv").orderBy("_p", "block")  # a row for each block, so few for any conversation
    ends = blocks.withColumns({"letters": F.array_join(F.transform("turns", lambda t: t["letter"]), ""), "first": F.lag("block").over(among).isNull(), "last": F.lead("block").over(among).isNull()})
    solved = stage(ends.mapInArrow(partial(_solved, costs=costs), SOLVED), "solved")
    costed = F.struct("_p", "block", F.transform("entries", lambda e: F.struct(e["came"].alias("came"), e["left"].alias("left"), e["cost"].alias("cost"), e["rank"].alias("rank"))).alias("entries"))
    gathered = solved.groupBy("_conv").agg(F.sort_array(F.collect_list(costed)).alias("blocks"))
    picks = gathered.mapInArrow(_picked, "_conv string, picks array<struct<_p: int, block: int, pick: int>>")
    chosen = picks.select("_conv", F.inline("picks"))
    edits = solved.join(chosen, ["_conv", "_p", "block"]).withColumn("edits", F.split(F.element_at("entries", F.col("pick") + 1)["edits"], " "))
    size = F.size("turns")
    listed = F.zip_with(F.slice("edits", F.lit(1), size), F.sequence(F.lit(1), size), lambda e, i: F.when((i == size) & (F.element_at("edits", -1) != ""), F.concat_ws("/", e, F.element_at("edits", -1))).otherwise(e))
    return edits.select("_conv", F.inline(F.arrays_zip(F.col("turns"), listed.alias("edit")))).select("_conv", "turns.turn", "turns.role", "turns.sha", "turns.n", "turns.fault", "edit")


REPAIRED = "_conv string, turn bigint, was string, n bigint, fault string, edit string, role string, text string"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by turn, an edit before the rows it is for: one row for each distinct turn and each insert."""
    schema = pa.schema([("_conv", pa.string()), ("turn", pa.int64()), ("was", pa.string()), ("n", pa.int64()), ("fault", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    edit = None
    for batch in batches:
        out: list[tuple] = []
        text = batch["text"]
        for i, (conv, turn, role, n, fault, own) in enumerate(zip(*(batch[c].to_pylist() for c in ("_conv", "turn", "role", "n", "fault", "edit")), strict=True)):
            if own is not None:
                edit = (n, fault, own)
                continue
            if edit is None:
                continue  # another row of the same turn
            (n, fault, own), edit = edit, None
            own, _, end = own.partition("/")
            out += [(conv, None, None, 0, "", "I", ROLE[U if c == "U" else A], "") for c in own[:-1]]
            letter, text_there = own[-1], None if own[-1] == "D" else text[i].as_py()
            out.append((conv, turn, role, n, fault, "R" if letter in "ua" else letter, {"u": ROLE[U], "a": ROLE[A]}.get(letter, role), text_there))
            out += [(conv, None, None, 0, "", "I", ROLE[U if c == "U" else A], "") for c in end]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def apply_edits(keyed: DataFrame, edits: DataFrame, together: bool = False) -> DataFrame:
    """The turns with their edits: (_conv, turn, was, n, fault, edit, role, text), and rows of edit I for inserted turns.
    Turns are dealt by all they are told apart by; ``together`` deals them by conversation, each in its order."""
    texts = keyed.select("*", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("edit"))
    both = edits.select("_conv", "turn", "role", F.lit(None).cast("string").alias("text"), "sha", F.lit(0).alias("kind"), "n", "fault", "edit").unionByName(texts)
    keys = ["_conv"] if together else ["_conv", "turn", "role", "sha"]
    return both.repartition(*keys).sortWithinPartitions("_conv", "turn", "role", "sha", "kind").mapInArrow(_repaired, REPAIRED)


def repair(rows: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, turn, was, n, fault, edit, role, text): every distinct turn of ``rows`` (conv_id, turn, role, text) in its
    conversation with its edit (Keep, Rerole, Delete) and its new role; of ``n`` identical turns the others go. Inserted
    turns have edit I and the place of the turn they stand before: they come right before it, or at the end after it."""
    keyed = _keyed(rows)
    out = apply_edits(keyed, plan_edits(keyed, costs))
    kind = rows.schema["conv_id"].dataType
    return out.select(F.when(F.col("_conv") != "", F.substr("_conv", F.lit(2))).cast(kind).alias("conv_id"), *[c for c in out.columns if c != "_conv"])


DIGEST = "_conv string, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _digested(batches: Iterator[pa.RecordBatch], costs: Costs) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of rows in order; only counts, the audit and a running hash are held."""
    conv, state, done = None, None, []

    def closed() -> tuple:
        gaps = state["most"] - state["least"] + 1 - state["turns"] if state["turns"] else 0
        return (conv, gaps, state["blank"], state["duplicate"], state["truncated"], state["illegal"], state["cost"], "".join(state["audit"]), state["sha"].hexdigest())

    def batch_of() -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

    for batch in batches:
        for own, turn, was, n, fault, edit, role, text in zip(*(batch[c].to_pylist() for c in ("_conv", "turn", "was", "n", "fault", "edit", "role", "text")), strict=True):
            if own != conv:
                if state:
                    done.append(closed())
                conv, state = own, {"turns": 0, "least": 0, "most": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None}
            state["audit"].append(edit + "D" * (n - 1))
            if edit != "I":
                if turn is not None and (not state["turns"] or turn != state["most"]):
                    state["least"] = state["least"] if state["turns"] else turn
                    state["most"], state["turns"] = turn, state["turns"] + 1
                if fault:
                    state[fault] += 1
                state["blank" if fault == "blank" else "duplicate"] += n - 1
                state["illegal"] += n - 1 + (state["before"] is not None and state["before"] + was[:1] not in ("su", "ua", "au"))
                state["before"] = was[:1]
                state["cost"] += costs.delete * (n - 1) + (costs.truncated if fault == "truncated" and edit != "D" else 0)
            state["cost"] += {"D": costs.delete, "R": costs.rerole, "I": costs.insert, "K": 0}[edit]
            if edit != "D":
                state["sha"].update(("\n" if state["any"] else "").encode() + f"{role}:{text}".encode())
                state["any"] = True
        if done:
            yield batch_of()
            done = []
    if state:
        done.append(closed())
        yield batch_of()


def digest(rows: DataFrame, all_ids: DataFrame, costs: Costs = Costs(), block: int = BLOCK) -> DataFrame:
    """For each conv_id of ``all_ids`` what the contract asks of the conversations ``rows`` and of their repair."""
    keyed = _keyed(rows)
    found = apply_edits(keyed, plan_edits(keyed, costs, block), together=True).mapInArrow(partial(_digested, costs=costs), DIGEST)
    joined = all_ids.select("conv_id").distinct().withColumn("_conv", _conv()).join(found, "_conv", "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return joined.select("conv_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
