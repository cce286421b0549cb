"""Statements and intrinsic functions of record programs as Column expressions.

Moves, conditions, arithmetic, strings and dates. Clock operators take a timestamp column, never the wall clock.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- moves and assignment

#: Figurative constants by name.
FIGURATIVE = {"ZERO": "0", "SPACE": " ", "QUOTE": '"', "HIGH-VALUE": "ÿ", "LOW-VALUE": "\u0000"}


def move_numeric(text: Column, size: int) -> Column:
    """The right-most ``size`` characters of the trimmed text, zero-padded on the left."""
    return F.lpad(F.right(F.trim(text), F.lit(size)), size, "0")


def move_text(text: Column, size: int) -> Column:
    """Left-justified, blank-padded or cut on the right."""
    return F.rpad(text, size, " ")


def move_decimal(value: Column, precision: int, scale: int) -> Column:
    """Numeric to numeric: truncate the fraction toward zero, keep the low-order integer digits."""
    cut = truncate(value, scale)
    return (cut % F.lit(10 ** (precision - scale)).cast(f"decimal({precision - scale + 1},0)")).cast(f"decimal({precision},{scale})")


def figurative(name: str, size: int = 1) -> Column:
    """A figurative constant, or ALL "literal", repeated to ``size``."""
    key = re.sub(r"(ZERO|SPACE|QUOTE|VALUE)(E?S)$", r"\1", name.upper())
    unit = FIGURATIVE.get(key) or name.removeprefix("ALL ").strip("\"'")
    return F.substring(F.repeat(F.lit(unit), -(-size // len(unit))), 1, size)


def move_corresponding(df: DataFrame, source: str, target: str) -> DataFrame:
    """Copy the fields of struct ``source`` to the fields of the same name of struct ``target``."""
    names = {f.name for f in df.schema[source].dataType}
    fields = [F.col(f"{source}.{f.name}").cast(f.dataType).alias(f.name) if f.name in names else F.col(f"{target}.{f.name}") for f in df.schema[target].dataType]
    return df.withColumn(target, F.struct(*fields))


def combine_corresponding(df: DataFrame, source: str, target: str, sign: int = 1) -> DataFrame:
    """ADD (sign 1) or SUBTRACT (sign -1) CORRESPONDING: numeric fields of the same name."""
    from pyspark.sql.types import NumericType

    names = {f.name for f in df.schema[source].dataType if isinstance(f.dataType, NumericType)}
    fields = []
    for f in df.schema[target].dataType:
        own = F.col(f"{target}.{f.name}")
        if f.name in names and isinstance(f.dataType, NumericType):
            other = F.col(f"{source}.{f.name}")
            own = (own + other if sign > 0 else own - other).cast(f.dataType)
        fields.append(own.alias(f.name))
    return df.withColumn(target, F.struct(*fields))


def reference(text: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Reference modification: a 1-based start that is 1 at least; too long a slice is clipped."""
    start = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1))
    if length is None:
        return F.substr(text, start)
    return F.substr(text, start, F.lit(length) if isinstance(length, int) else length)


def initialize(df: DataFrame, replacing: Mapping[str, object] | None = None) -> DataFrame:
    """INITIALIZE: numbers to zero, text to blanks of its length, or the given value for a category."""
    from pyspark.sql.types import NumericType, StringType

    given = dict(replacing or {})
    columns = {}
    for f in df.schema:
        if isinstance(f.dataType, NumericType):
            columns[f.name] = F.lit(given.get("NUMERIC", 0)).cast(f.dataType)
        elif isinstance(f.dataType, StringType):
            columns[f.name] = F.lit(given["ALPHANUMERIC"]) if "ALPHANUMERIC" in given else F.repeat(F.lit(" "), F.length(f.name))
    return df.withColumns(columns)


# ---- conditions


def is_numeric(text: Column) -> Column:
    """An optional sign, digits and at most one point, one character at least after trimming."""
    body = F.trim(text)
    return body.rlike(r"^[+-]?[0-9]*\.?[0-9]*$") & body.rlike(r"[0-9.]")


def is_numeric_loose(text: Column) -> Column:
    return text.rlike(r"^[0-9.+-]+$")


def is_alphabetic(text: Column, case: str | None = None) -> Column:
    """Letters and blanks only; the empty string is alphabetic. case: None, "upper" or "lower"."""
    letter = {None: r"\p{L}", "upper": r"\p{Lu}", "lower": r"\p{Ll}"}[case]
    return text.rlike(f"^[{letter} ]*$")


def sign_test(value: Column, kind: str) -> Column:
    return {"POSITIVE": value > 0, "NEGATIVE": value < 0, "ZERO": value == 0}[kind]


def condition_name(field: Column, values: Sequence[object]) -> Column:
    """An 88-level: single values, or (low, high) for THRU."""
    single = [v for v in values if not isinstance(v, tuple)]
    tests = [field.between(*v) for v in values if isinstance(v, tuple)] + ([field.isin(*single)] if single else [])
    return reduce(lambda a, b: a | b, tests)


def set_condition(values: Sequence[object]) -> Column:
    """SET name TO TRUE assigns the first value."""
    first = values[0]
    return F.lit(first[0] if isinstance(first, tuple) else first)


def decode_enum(field: Column, labels: Mapping[object, str]) -> Column:
    """Code to label; null for an unknown code."""
    return reduce(lambda done, kv: done.when(field == kv[0], kv[1]), list(labels.items())[1:], F.when(field == next(iter(labels)), next(iter(labels.values()))))


def compare_text(a: Column, b: Column) -> Column:
    """-1, 0 or 1 by code points, the shorter side padded with blanks on the right."""
    width = F.greatest(F.length(a), F.length(b))
    left, right = (F.concat(x, F.repeat(F.lit(" "), width - F.length(x))) for x in (a, b))
    return F.when(left < right, -1).when(left > right, 1).otherwise(0)


def evaluate(subjects: Sequence[Column], whens: Sequence[tuple[Sequence[object], object]], other: object = None) -> Column:
    """EVALUATE … ALSO …: the first row whose entries all hold. An entry is a value, a (low, high) range, None for ANY,
    ("NOT", entry), or a boolean Column (EVALUATE TRUE)."""

    def holds(subject: Column, entry: object) -> Column:
        if entry is None:
            return F.lit(True)
        if isinstance(entry, Column):
            return entry
        if isinstance(entry, tuple) and entry[0] == "NOT":
            return ~holds(subject, entry[1])
        return subject.between(*entry) if isinstance(entry, tuple) else subject == entry

    out = F
    for entries, result in whens:
        out = out.when(reduce(lambda a, b: a & b, [holds(s, e) for s, e in zip(subjects, entries, strict=True)]), result)
    return out.otherwise(other)


def go_to_depending(value: Column, targets: Sequence[str]) -> Column:
    """The 1-based target; null (fall through) if out of range."""
    return F.get(F.array(*[F.lit(t) for t in targets]), value.cast("int") - 1)


# ---- arithmetic


def rounded(value: Column, scale: int, mode: str = "half_even") -> Column:
    """half_even (default), half_up, or down."""
    return {"half_even": F.bround, "half_up": F.round, "down": truncate}[mode](value, scale)


def truncate(value: Column, scale: int) -> Column:
    factor = F.lit(10**scale).cast(f"decimal({scale + 1},0)")
    scaled = value * factor
    return (F.when(value < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / factor).cast(f"decimal(28,{scale})")


def size_error(value: Column, integers: int, decimals: int) -> Column:
    """Whether |value| is above the largest number of the picture."""
    return F.abs(value) > F.lit("9" * integers + ("." + "9" * decimals if decimals else "")).cast(f"decimal({integers + decimals},{decimals})")


def on_size_error(value: Column, integers: int, decimals: int, keep: Column) -> Column:
    """The new value, or what was there before if it does not fit."""
    return F.when(size_error(value, integers, decimals), keep).otherwise(value)


def add(terms: Sequence[Column], to: Column | None = None) -> Column:
    return reduce(lambda a, b: a + b, [*terms, *([to] if to is not None else [])])


def subtract(terms: Sequence[Column], from_: Column) -> Column:
    return from_ - add(terms)


def multiply(a: Column, by: Column) -> Column:
    return a * by


def divide(dividend: Column, divisor: Column, scale: int = 0) -> tuple[Column, Column]:
    """(quotient truncated to the scale, remainder); both null if the divisor is zero."""
    quotient = truncate(F.try_divide(dividend, divisor), scale)
    return quotient, dividend - quotient * divisor


def annuity(rate: Column, periods: Column) -> Column:
    """Payment for one unit; 1 / periods at no interest."""
    return F.when(rate == 0, 1.0 / periods).otherwise(rate / (1 - F.pow(1 + rate, -periods)))


def present_value(rate: Column, amounts: Column) -> Column:
    """Of an array of amounts at the ends of successive periods."""
    return F.aggregate(
        F.arrays_zip(amounts.alias("a"), F.sequence(F.lit(1), F.size(amounts)).alias("k")),
        F.lit(0.0),
        lambda acc, x: acc + x["a"] / F.pow(1 + rate, x["k"]),
    )


#: Intrinsic functions by name.
INTRINSICS = {
    "ABS": F.abs, "SQRT": F.sqrt, "SIN": F.sin, "COS": F.cos, "TAN": F.tan, "LOG": F.ln, "LOG10": F.log10, "EXP": F.exp,
    "MAX": F.greatest, "MIN": F.least, "MOD": F.pmod, "REM": lambda a, b: a % b, "INTEGER": F.floor,
    "INTEGER-PART": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), "RANDOM": F.rand,
    "UPPER-CASE": F.upper, "LOWER-CASE": F.lower, "LENGTH": F.length, "TRIM": F.trim, "REVERSE": F.reverse,
    "ORD": lambda c: F.ascii(c) + 1, "CHAR": lambda n: F.chr(n - 1), "ANNUITY": annuity, "PRESENT-VALUE": present_value,
}


# ---- strings


def numval(text: Column) -> Column:
    """The number in a text; 0 if empty."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("decimal(31,8)"), F.lit(0).cast("decimal(31,8)"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c for c in text)


def tally_all(text: Column, target: str) -> Column:
    """Non-overlapping occurrences; none of the empty string."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(target)))) / len(target)).cast("long") if target else F.lit(0).cast("long")


def tally_leading(text: Column, target: str) -> Column:
    return F.floor(F.length(F.regexp_extract(text, f"^(?:{_quoted(target)})*", 0)) / len(target)).cast("long")


def tally_characters(text: Column, before: str | None = None) -> Column:
    """All characters, or those before the first occurrence of ``before`` (all, if there is none)."""
    if before is None:
        return F.length(text).cast("long")
    at = F.instr(text, before)
    return F.when(at > 0, at - 1).otherwise(F.length(text)).cast("long")


def replace_all(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def replace_first(text: Column, old: str, new: str) -> Column:
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(new), F.substr(text, at + len(old)))).otherwise(text)


def replace_leading(text: Column, old: str, new: str) -> Column:
    """Every occurrence in the leading run, one for one."""
    run = F.regexp_extract(text, f"^(?:{_quoted(old)})*", 0)
    return F.concat(F.repeat(F.lit(new), F.floor(F.length(run) / len(old)).cast("int")), F.substr(text, F.length(run) + 1))


def replace_trailing(text: Column, old: str, new: str) -> Column:
    run = F.regexp_extract(text, f"(?:{_quoted(old)})*$", 0)
    return F.concat(F.left(text, F.length(text) - F.length(run)), F.repeat(F.lit(new), F.floor(F.length(run) / len(old)).cast("int")))


def replace_characters(text: Column, new: str, before: str | None = None) -> Column:
    n = tally_characters(text, before).cast("int")
    return F.concat(F.repeat(F.lit(new), n), F.substr(text, n + 1))


def converting(text: Column, old: str, new: str) -> Column:
    """Character for character; the first of equal characters in ``old`` counts; others stay."""
    pairs = {}
    for a, b in zip(old, new, strict=True):
        pairs.setdefault(a, b)
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def string_into(parts: Sequence[tuple[Column, str | None]], target: Column | None = None, pointer: int = 1) -> Column:
    """STRING: each part up to its delimiter (None: by SIZE), joined; placed in ``target`` from ``pointer`` on."""
    joined = F.concat(*[F.substring_index(c, d, 1) if d is not None else c for c, d in parts])
    return joined if target is None else F.overlay(target, F.left(joined, F.length(target) - (pointer - 1)), F.lit(pointer), F.length(F.left(joined, F.length(target) - (pointer - 1))))


def string_overflow(parts: Sequence[tuple[Column, str | None]], size: int, pointer: int = 1) -> Column:
    return F.length(string_into(parts)) > size - (pointer - 1)


def unstring(text: Column, delimiters: Sequence[str], targets: int, all_: bool = False, pointer: Column | None = None) -> dict[str, Column]:
    """UNSTRING: fields ("" if missing), their delimiters and counts, and the number of fields filled.

    With a pointer (from 1) the scan begins there; ``pointer`` is then the place after what was taken, and ``overflow``
    tells of a pointer outside the text, which fills nothing, or of text that is left.
    """
    pattern = "|".join(f"(?:{_quoted(d)})" + ("+" if all_ else "") for d in delimiters)
    fits = pointer.between(1, F.length(text)) if pointer is not None else F.lit(True)
    rest = text if pointer is None else F.when(fits, F.substr(text, pointer))
    parts = F.split(rest, pattern)
    marks = F.regexp_extract_all(rest, F.lit(f"({pattern})"), F.lit(1))
    out = {}
    for k in range(targets):
        out[f"field_{k + 1}"] = F.coalesce(F.get(parts, F.lit(k)), F.lit(""))
        out[f"delimiter_{k + 1}"] = F.coalesce(F.get(marks, F.lit(k)), F.lit(""))
        out[f"count_{k + 1}"] = F.length(out[f"field_{k + 1}"]).cast("long")
    out["tally"] = F.least(F.coalesce(F.size(parts), F.lit(0)), F.lit(targets)).cast("long") if pointer is None else F.when(fits, F.least(F.size(parts), F.lit(targets))).otherwise(0).cast("long")
    if pointer is not None:
        taken = sum((out[f"count_{k + 1}"] + F.length(out[f"delimiter_{k + 1}"]) for k in range(targets)), F.lit(0))
        out["pointer"] = (pointer + F.when(fits, taken).otherwise(0)).cast("long")
        out["overflow"] = ~fits | (F.size(parts) > targets)
    return out


def to_display(value: Column, size: int) -> Column:
    """A whole number with at least ``size`` digits and a minus sign if negative."""
    digits = F.abs(value).cast("string")
    return F.concat(F.when(value < 0, "-").otherwise(""), F.repeat(F.lit("0"), F.greatest(F.lit(size) - F.length(digits), F.lit(0))), digits)


def to_picture(value: Column, size: int, decimals: int, signed: bool = False) -> Column:
    """Half-even rounded, zero-padded to ``size`` digits in all, with a point; with + or - if signed."""
    number = F.bround(value, decimals).cast(f"decimal(30,{decimals})")
    text = F.lpad(F.abs(number).cast("string"), size + (decimals > 0), "0")
    sign = F.when(number < 0, "-")
    return F.concat(sign.otherwise("+") if signed else sign.otherwise(""), text)


def identifier(name: Column, style: str = "camel") -> Column:
    """pascal, camel, or method (a numeric prefix goes first) case of NAME-LIKE-THIS."""
    if style == "method":
        name = F.regexp_replace(name, r"^\d+[-_]?", "")
    pascal = F.replace(F.initcap(F.translate(F.lower(name), "-_", "  ")), F.lit(" "))
    return pascal if style == "pascal" else F.concat(F.lower(F.left(pascal, F.lit(1))), F.substr(pascal, F.lit(2)))


def copy_replacing(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """COPY … REPLACING: whole-word substitutions, in order."""
    return reduce(lambda t, p: F.regexp_replace(t, f"(?<![A-Za-z0-9-]){_quoted(p[0])}(?![A-Za-z0-9-])", p[1].replace("\\", "\\\\").replace("$", "\\$")), pairs, text)


def cache_key(url: Column, branch: Column) -> Column:
    return F.base64(F.encode(F.concat_ws(":", url, branch), "UTF-8"))


# ---- dates


def accept_date(ts: Column, short: bool = False) -> Column:
    return F.date_format(ts, "yyMMdd" if short else "yyyyMMdd")


def accept_time(ts: Column) -> Column:
    """HHMMSS and hundredths."""
    return F.date_format(ts, "HHmmssSS")


def accept_day(ts: Column) -> Column:
    """YYDDD."""
    return F.concat(F.date_format(ts, "yy"), F.lpad(F.dayofyear(ts).cast("string"), 3, "0"))


def day_of_week(ts: Column) -> Column:
    """1 on Mondays to 7 on Sundays."""
    return F.weekday(ts) + 1


def current_date(ts: Column) -> Column:
    """21 characters: date, time with hundredths, and the offset of the session's zone."""
    return F.date_format(ts, "yyyyMMddHHmmssSSxx")


def integer_of_date(yyyymmdd: Column, epoch: str = "1970") -> Column:
    """Days with 1970-01-01 as day 1 (default), or 1601-01-01 as day 1 ("iso1601")."""
    day = F.unix_date(F.to_date(F.lpad(yyyymmdd.cast("string"), 8, "0"), "yyyyMMdd"))
    return day + (1 if epoch == "1970" else 134775)


def date_of_integer(day: Column, epoch: str = "1970") -> Column:
    return F.date_format(F.date_from_unix_date((day - (1 if epoch == "1970" else 134775)).cast("int")), "yyyyMMdd").cast("int")


def plausible_date(yyyymmdd: Column) -> Column:
    """Eight digits, month 01-12 and day 01-31 (not a calendar check)."""
    text = yyyymmdd.cast("string")
    return text.rlike(r"^\d{8}$") & F.substr(text, F.lit(5), F.lit(2)).between("01", "12") & F.substr(text, F.lit(7), F.lit(2)).between("01", "31")
