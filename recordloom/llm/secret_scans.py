"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every document is addressed by the SHA-256 of its text. The ledger has a row for each (blob, rule,
version) that was scanned, with the spans found there (often none). A scan takes the distinct blobs, leaves out the
pairs of blob and rule version that the ledger has, reads each remaining text once, and joins the findings back to
all rows that hold the blob.

Offsets count code points, ends are exclusive. The matcher has no offsets to give, so they follow from the lengths of
the matches and of the gaps between them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.staging import look_up, stage


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    pattern: str
    group: int  #: the group whose length counts
    least: int  #: its least length; shorter matches are dropped after matching


# Kinds, patterns and least lengths of the contract, in its order.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
)
#: The same matches of hex runs and access keys, found without stopping at every short run.
FAST = {"access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
LEDGER = "blob string, rule string, version int, spans array<struct<start: bigint, end: bigint>>"
#: Matches whose spans are gathered at once.
CHUNK = 500
SPANS = "array<struct<start: bigint, end: bigint>>"


def spans_of(text: Column, rule: Rule) -> Column:
    """The rule's spans in ``text`` as array<struct<start, end>>, leftmost and non-overlapping; empty for null."""
    pattern = FAST.get(rule.name, rule.pattern)
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)) if rule.group else matches
    measured = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda gap: F.char_length(gap).cast("long")).alias("gap"),
        F.transform(matches, lambda m: F.char_length(m).cast("long")).alias("length"),
        F.transform(sized, lambda m: F.char_length(m) >= rule.least).alias("counts"),
    )
    size = lambda m: m["gap"] + F.coalesce(m["length"], F.lit(0))
    nothing = F.expr(f"cast(array() as {SPANS})")

    def walked(chunk: Column, start: Column) -> Column:
        """The spans of some matches and gaps, of which the first begins at ``start``."""
        return F.aggregate(
            chunk,
            F.struct(start.alias("at"), nothing.alias("spans")),
            lambda acc, m: F.struct(
                (acc["at"] + size(m)).alias("at"),
                F.when(m["counts"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + m["gap"]).alias("start"), (acc["at"] + m["gap"] + m["length"]).alias("end"))))).otherwise(acc["spans"]).alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    def gathered(chunks: Column) -> Column:
        """In chunks, so that no array grows by one element at a time over a whole text."""
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda at, m: at + size(m)))
        starts = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(chunks, F.slice(starts, F.lit(1), F.size(chunks)), walked))

    chunked = lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / CHUNK).cast("int")), lambda k: F.slice(m, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(text.rlike(pattern), _let(measured, lambda m: _let(chunked(m), gathered))).otherwise(nothing)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _place() -> Column:
    """Where a blob's text is found: rows without an id go by the blob, so they don't meet in one task."""
    return F.coalesce("doc_id", F.xxhash64("blob"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger rows that ``docs`` (doc_id, text) add to ``ledger``: pairs of blob and rule version not in it yet."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = rows.withColumn("blob", blob_of(F.col("text")))
    first = blobs.select("blob", _place().alias("doc_id")).groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
    versions = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = first.withColumn("todo", F.transform(versions, lambda v: v["rule"]))
    else:
        pairs = first.select("blob", "doc_id", F.inline(versions))
        todo = pairs.join(ledger.select("blob", "rule", "version"), ["blob", "rule", "version"], "left_anti").groupBy("blob", "doc_id").agg(F.collect_set("rule").alias("todo"))
    texts = blobs.withColumn("doc_id", _place()).join(todo.withColumnRenamed("blob", "owner"), "doc_id").filter("blob = owner")
    found = [
        F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", r.name), spans_of(F.col("text"), r)).alias("spans"))
        for r in rules
    ]
    scanned = texts.select("blob", F.explode(F.array(*found)).alias("f")).select("blob", "f.rule", "f.version", "f.spans").filter("spans is not null")
    return scanned.dropDuplicates(["blob", "rule", "version"])


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``found``: array<struct<start, kind_no, end, kind>>, ordered, of the current rule versions.

    The join goes by blob; rows whose text is null have the empty blob. Every row of ``docs`` stays.
    """
    kind_no = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (r.name, k)])
    current = F.lit(False)
    for r in rules:
        current = current | ((F.col("rule") == r.name) & (F.col("version") == r.version))
    spans = ledger.filter(current & (F.size("spans") > 0)).select("blob", F.transform("spans", lambda s: F.struct(s["start"].alias("start"), kind_no[F.col("rule")].alias("kind_no"), s["end"].alias("end"), F.col("rule").alias("kind"))).alias("own"))
    per_blob = spans.groupBy(F.col("blob").alias("_blob")).agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("found"))
    joined = look_up(docs.withColumn("_blob", blob_of(F.col("text"))), per_blob, ["_blob"], F.col("doc_id"), most=50_000)
    return joined.withColumn("found", F.coalesce("found", F.expr("cast(array() as array<struct<start: bigint, kind_no: int, end: bigint, kind: string>>)"))).drop("_blob")


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings of every row of ``docs``, the ledger with the new rows).

    Null text is the empty text; rows that repeat a doc_id or a text get findings each; an empty table gives none.
    Very long texts are scanned whole, and matches that begin
    together are ordered by kind. Columns of ``docs`` named found, _blob or _salt are replaced.
    """
    docs = docs.drop("found", "_blob", "_salt")
    new = stage(scan(docs, ledger, rules), "ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return findings(docs, whole, rules), whole


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts by kind, SHA-256 of the spans and the spans as kind:start:end, comma-joined."""
    joined = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.array_remove(F.transform(kinds, lambda k: F.when(k == F.lit(r.name), k).otherwise("")), "")).cast("long").alias(f"n_{r.name}") for r in rules]
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of ``found`` replaced by ``mark``; overlapping spans share one mark."""
    walked = F.aggregate(
        "found",
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substr(F.col("text"), (acc["at"] + 1).cast("int"))),
    )
    return found.withColumn("text", F.when(F.size("found") > 0, walked).otherwise(F.col("text"))).drop("found")


def _sql() -> str:
    quoted = {r.name: r.pattern.replace("'", "''") for r in RULES}
    parts = []
    for k, r in enumerate(RULES):
        matches = f"regexp_extract_all(text, '{quoted[r.name]}', 0)"
        sized = f"regexp_extract_all(text, '{quoted[r.name]}', {r.group})"
        parts.append(f"""
  SELECT doc_id, {k} AS kind_no, '{r.name}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s, length(ms[i]) AS n
  FROM (SELECT doc_id, ms, sized, gaps, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, {matches} AS ms, {sized} AS sized, string_split_regex(text, '{quoted[r.name]}') AS gaps FROM texts)) t
  WHERE length(sized[i]) >= {r.least}""")
    counts = ", ".join(f"CAST(count(kind) FILTER (kind = '{r.name}') AS BIGINT) AS n_{r.name}" for r in RULES)
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
joined AS (
  SELECT d.doc_id, {counts},
         coalesce(string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, kind_no), '') AS spans
  FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id)
SELECT doc_id, {", ".join(f"n_{r.name}" for r in RULES)}, sha256(spans) AS base_sha256, spans FROM joined
"""


ORACLE_SQL = _sql()
