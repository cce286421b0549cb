"""Embedded SQL: classification and lineage of statements as columns, and execution with an SQLCODE outcome."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.sorted_files import SortedStore
from recordloom.sources.staged import new_path

# Leading words of a statement and its type, in the order they are tried.
STATEMENT_TYPES = (
    "SELECT", "INSERT", "UPDATE", "DELETE", ("OPEN", "OPEN_CURSOR"), "FETCH", ("CLOSE", "CLOSE_CURSOR"), "COMMIT", "ROLLBACK", "INCLUDE", "WHENEVER", "BEGIN", "END",
    "CALL", "SET", "PREPARE", "EXECUTE", "DESCRIBE", "LOCK", "SAVEPOINT",
)
# SQLCODEs and their texts (0 is success).
SQLCODES = {100: "No data found", -803: "Duplicate key", -811: "Multiple rows returned", -904: "Resource unavailable", -911: "Deadlock or timeout", -913: "Deadlock detected"}
NAME = r"[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*)?"


def statement_type(sql: Column) -> Column:
    text = F.upper(F.trim(sql))
    out = F.when(F.startswith(text, F.lit("DECLARE")) & F.contains(text, F.lit("CURSOR")), "DECLARE_CURSOR")
    for entry in STATEMENT_TYPES:
        word, kind = entry if isinstance(entry, tuple) else (entry, entry)
        out = out.when(F.startswith(text, F.lit(word)), kind)
    return out.otherwise("UNKNOWN")


def tables(sql: Column) -> Column:
    """Distinct table names after FROM, INTO (of an INSERT), UPDATE and JOIN; host variables are no tables."""
    after = lambda word: F.regexp_extract_all(sql, F.lit(f"(?i)\\b{word}\\s+({NAME})"), F.lit(1))
    into = F.when(sql.rlike(r"(?is)\bSELECT\b.*\bINTO\b"), F.expr("cast(array() as array<string>)")).otherwise(after("INTO"))
    return F.array_distinct(F.concat(after("FROM"), into, after("UPDATE"), after("JOIN")))


def where_clause(sql: Column) -> Column:
    """The condition up to ORDER, GROUP, HAVING, UNION, FOR or the end; null without one."""
    return F.nullif(F.trim(F.regexp_extract(sql, r"(?is)\bWHERE\s+(.*?)(?=\s+(?:ORDER|GROUP|HAVING|UNION|FOR)\b|$)", 1)), F.lit(""))


def into_variables(sql: Column) -> Column:
    """The host variables between INTO and FROM of a SELECT."""
    part = F.regexp_extract(sql, r"(?is)^\s*SELECT\b.*?\bINTO\s+(.*?)\s+FROM\b", 1)
    return F.regexp_extract_all(part, F.lit(r":\s*([A-Za-z][A-Za-z0-9_-]*)"), F.lit(1))


def without_into(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?is)\bINTO\s+:.*?(?=\bFROM\b)", "")


def host_variables(sql: Column) -> Column:
    """array<struct<name, indicator>> of :NAME, with the indicator of :NAME:IND or :NAME :IND."""
    found = F.regexp_extract_all(sql, F.lit(r"(:[A-Za-z][A-Za-z0-9_-]*(?:\s*:[A-Za-z][A-Za-z0-9_-]*)?)"), F.lit(1))
    return F.transform(found, lambda v: F.struct(F.regexp_extract(v, r"^:([A-Za-z][A-Za-z0-9_-]*)", 1).alias("name"), F.nullif(F.regexp_extract(v, r"^:[A-Za-z][A-Za-z0-9_-]*\s*:([A-Za-z0-9_-]+)", 1), F.lit("")).alias("indicator")))


def cursor_name(sql: Column) -> Column:
    return F.nullif(F.upper(F.regexp_extract(sql, r"(?i)^\s*(?:DECLARE|OPEN|CLOSE|FETCH(?:\s+(?:NEXT|PRIOR|FIRST|LAST|CURRENT|FROM))*)\s+([A-Za-z][A-Za-z0-9_-]*)", 1)), F.lit(""))


def blocks(source: Column, kind: str = "SQL") -> Column:
    """The bodies of EXEC SQL (or CICS) … END-EXEC blocks, in order, with white space as single blanks."""
    found = F.regexp_extract_all(source, F.lit(rf"(?is)\bEXEC\s+{kind}\s+(.*?)\s*\bEND-EXEC"), F.lit(1))
    return F.transform(found, lambda b: F.trim(F.regexp_replace(b, r"\s+", " ")))


def cics_options(block: Column) -> tuple[Column, Column]:
    """(command, map of option to argument; "" without one) of a CICS block."""
    command = F.upper(F.regexp_extract(block, r"^\s*([A-Za-z]+)", 1))
    rest = F.regexp_replace(block, r"^\s*[A-Za-z]+\s*", "")
    names = F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9-]+)\s*(?:\(([^)]*)\))?"), F.lit(1))
    values = F.regexp_extract_all(rest, F.lit(r"([A-Za-z0-9-]+)\s*(?:\(([^)]*)\))?"), F.lit(2))
    pairs = F.arrays_zip(F.transform(names, F.upper).alias("k"), F.transform(values, F.trim).alias("v"))
    return command, F.map_from_entries(F.array_distinct(pairs))


def sqlcode_text(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SQLCODES.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.when(code < 0, F.concat(F.lit("SQL error: "), code.cast("string"))))


def sqlcode_class(code: Column) -> Column:
    return F.when(code == 0, "success").when(code == 100, "not_found").when(code < 0, "error").when(code.between(1, 99), "warning").otherwise("other")


def indicator(value: Column) -> Column:
    """-1 for null, else 0."""
    return F.when(value.isNull(), -1).otherwise(0)


def with_default(value: Column, indicator_: Column, default: object) -> Column:
    return F.when(indicator_ < 0, F.lit(default)).otherwise(value)


# ---- execution


@dataclass(frozen=True)
class Outcome:
    """The result of an action: value, SQLCODE, SQLSTATE and the number of rows."""

    value: object = None
    sqlcode: int = 0
    sqlstate: str = "00000"
    rows: int = 0

    is_success = property(lambda self: self.sqlcode == 0)
    is_not_found = property(lambda self: self.sqlcode == 100)
    is_error = property(lambda self: self.sqlcode < 0)
    is_warning = property(lambda self: 0 < self.sqlcode < 100)

    def map(self, f: object) -> Outcome:
        return replace(self, value=f(self.value)) if self.is_success else self

    def flat_map(self, f: object) -> Outcome:
        return f(self.value) if self.is_success else self

    def get_or_else(self, default: object) -> object:
        return self.value if self.is_success else default


def to_spark(sql: str) -> str:
    """Rewrite what Spark's parser doesn't take: FETCH FIRST, FOR UPDATE, INTO and hyphens of host variables."""
    sql = re.sub(r"(?is)\bINTO\s+:.*?(?=\bFROM\b)", "", sql)
    sql = re.sub(r"(?i)\bFETCH\s+FIRST\s+(?:(\d+)\s+)?ROWS?\s+ONLY\b", lambda m: f"LIMIT {m[1] or 1}", sql)
    sql = re.sub(r"(?i)\bFOR\s+(?:UPDATE(?:\s+OF\s+[\w,\s]+)?|READ\s+ONLY|FETCH\s+ONLY)\s*$", "", sql.strip())
    return re.sub(r":([A-Za-z][A-Za-z0-9_-]*)", lambda m: f":{parameter(m[1])}", sql)


def parameter(name: str) -> str:
    return name.lower().replace("-", "_")


def query(spark: SparkSession, sql: str, args: Mapping[str, object] | None = None, **frames: DataFrame) -> DataFrame:
    """Parameterised SQL over named frames; arguments by host-variable name."""
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
    return spark.sql(to_spark(sql), args={parameter(k): v for k, v in (args or {}).items()})


def select_into(df: DataFrame, strict: bool = False) -> Outcome:
    """One row: 0. None: 100. More: the first with warning 1, or -811 if strict."""
    rows = df.limit(2).collect()
    if not rows:
        return Outcome(None, 100, "02000")
    if len(rows) > 1:
        return Outcome(None, -811, "21000") if strict else Outcome(rows[0], 1, "01000", 1)
    return Outcome(rows[0], 0, "00000", 1)


def changed(count: int) -> Outcome:
    return Outcome(count, 0, "00000", count) if count else Outcome(0, 100, "02000")


class Cursor:
    """Forward fetches over a frame, a partition at a time on the driver."""

    def __init__(self, df: DataFrame):
        self.df, self.rows, self.fetched, self.current = df, None, 0, None

    def open(self) -> Outcome:
        self.rows, self.fetched, self.current = self.df.toLocalIterator(), 0, None
        return Outcome()

    def fetch(self) -> Outcome:
        if self.rows is None:
            return Outcome(None, -501, "24000")
        self.current = row = next(self.rows, None)
        if row is None:
            return Outcome(None, 100, "02000")
        self.fetched += 1
        return Outcome(row, 0, "00000", 1)

    def close(self) -> Outcome:
        if self.rows is None:
            return Outcome(None, -501, "24000")
        self.rows = self.current = None
        return Outcome()

    def where_current(self, keys: list[str]) -> Column | None:
        """WHERE CURRENT OF, as a condition on the keys of the row fetched last; None before a fetch and after the end."""
        if self.current is None:
            return None
        return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(self.current[k])) for k in keys])

    def __iter__(self) -> Iterator[Row]:
        while (one := self.fetch()).is_success:
            yield one.value


class ScrollCursor(Cursor):
    """A scrollable cursor over rows in an order. OPEN sorts them once, into a store with a directory of ranks; a fetch
    reads a page of rows around its position, from the file that holds it, and following fetches are served from it.

    The position is 0 before the first row and one more than the last after it; a fetch beyond either end leaves it there
    and gives 100. FETCH RELATIVE 0 gives the current row again."""

    def __init__(self, df: DataFrame, order: Sequence[str], path: str | None = None, page: int = 1_000):
        super().__init__(df)
        self.order, self.path, self.size, self.store, self.position, self.page, self.reads = list(order), path, page, None, 0, {}, 0

    def open(self) -> Outcome:
        self.store = SortedStore.write(self.df, self.path or new_path(self.df.sparkSession, "cursor"), self.order)
        self.position, self.page, self.current, self.fetched = 0, {}, None, 0
        return Outcome()

    def close(self) -> Outcome:
        if self.store is None:
            return Outcome(None, -501, "24000")
        self.store, self.page, self.current = None, {}, None
        return Outcome()

    def _at(self, position: int) -> Outcome:
        if self.store is None:
            return Outcome(None, -501, "24000")
        self.position = max(0, min(position, self.store.total + 1))
        if self.position != position or not 1 <= position <= self.store.total:
            self.current = None
            return Outcome(None, 100, "02000")
        if position not in self.page:
            first = max(1, position - self.size // 4)
            self.page = {r["rank"]: r for r in self.store.slice(first, first + self.size - 1).collect()}  # a page
            self.reads += 1
        found = self.page[position].asDict()
        del found["rank"]
        self.current = Row(**found)
        self.fetched += 1
        return Outcome(self.current, 0, "00000", 1)

    def fetch(self) -> Outcome:
        """FETCH NEXT."""
        return self._at(self.position + 1)

    def prior(self) -> Outcome:
        return self._at(self.position - 1)

    def first(self) -> Outcome:
        return self._at(1)

    def last(self) -> Outcome:
        return self.absolute(-1)

    def absolute(self, n: int) -> Outcome:
        """FETCH ABSOLUTE; negative positions count from the end, 0 is before the first row."""
        return self._at(n if n >= 0 or self.store is None else self.store.total + 1 + n)

    def relative(self, n: int) -> Outcome:
        return self._at(self.position + n)


class Transaction:
    """Tables as versions of frames: changes are staged by name and published together on commit."""

    def __init__(self, tables_: dict[str, DataFrame]):
        self.published, self.staged, self.savepoints = dict(tables_), dict(tables_), {}

    def __getitem__(self, name: str) -> DataFrame:
        return self.staged[name]

    def __setitem__(self, name: str, df: DataFrame) -> None:
        self.staged[name] = df

    def insert(self, name: str, rows: DataFrame) -> Outcome:
        self.staged[name] = self.staged[name].unionByName(rows)
        return changed(rows.count())

    def update(self, name: str, values: Mapping[str, Column], where: Column) -> Outcome:
        df = self.staged[name]
        n = df.filter(where).count()
        self.staged[name] = df.withColumns({c: F.when(where, v.cast(df.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})
        return changed(n)

    def delete(self, name: str, where: Column) -> Outcome:
        df = self.staged[name]
        self.staged[name] = df.filter(~F.coalesce(where, F.lit(False)))
        return changed(df.filter(where).count())

    def batch_update(self, name: str, key: str, params: DataFrame) -> DataFrame:
        """Set columns by key from a frame of parameters; the number of rows that each parameter row changed."""
        df = self.staged[name]
        columns = [c for c in params.columns if c != key]
        joined = df.join(params.select(key, F.struct(*columns).alias("_p")), key, "left")
        self.staged[name] = joined.select(*[F.when(F.col("_p").isNotNull(), F.col(f"_p.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])
        counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        return params.join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("updated"))

    def update_current(self, name: str, cursor: Cursor, keys: list[str], values: Mapping[str, Column]) -> Outcome:
        """UPDATE … WHERE CURRENT OF; -508 if the cursor is on no row."""
        where = cursor.where_current(keys)
        return Outcome(None, -508, "24504") if where is None else self.update(name, values, where)

    def delete_current(self, name: str, cursor: Cursor, keys: list[str]) -> Outcome:
        where = cursor.where_current(keys)
        return Outcome(None, -508, "24504") if where is None else self.delete(name, where)

    def savepoint(self, name: str) -> None:
        self.savepoints[name] = dict(self.staged)

    def rollback_to(self, name: str) -> None:
        self.staged = dict(self.savepoints[name])

    def commit(self) -> Outcome:
        self.published, self.savepoints = dict(self.staged), {}
        return Outcome()

    def rollback(self) -> Outcome:
        self.staged, self.savepoints = dict(self.published), {}
        return Outcome()


def whenever(outcome: Outcome, not_found: object = None, error: object = None, warning: object = None) -> object:
    """Call the handler for an outcome; an error without a handler raises."""
    if outcome.is_error and error is None:
        raise RuntimeError(f"SQLCODE {outcome.sqlcode}")
    handler = error if outcome.is_error else not_found if outcome.is_not_found else warning if outcome.is_warning else None
    return handler(outcome) if handler else outcome
