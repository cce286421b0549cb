"""Copybooks as schemas: PICTURE clauses, the item tree with byte offsets, and one select to decode or encode records.

Every elementary item becomes one builtin expression over its own byte slice, so unused fields cost nothing. OCCURS
becomes an array, REDEFINES a second reading of the same slice, RENAMES a reading of a byte range. OCCURS DEPENDING ON
is supported as the last item of a record: its length follows from the counter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import codecs
from recordloom.sources.staged import settled


@dataclass(frozen=True)
class Picture:
    text: str
    kind: str  #: numeric, alphabetic, alphanumeric or edited
    signed: bool = False
    integers: int = 0
    decimals: int = 0
    scaling: int = 0  #: zeros implied by P: positive to the right of the digits, negative to their left
    size: int = 0  #: characters

    @property
    def digits(self) -> int:
        return self.integers + self.decimals


def parse_picture(text: str) -> Picture:
    """Classify a PICTURE string and count its positions; c(n) stands for n times c."""
    body = re.sub(r"(.)\((\d+)\)", lambda m: m[1] * int(m[2]), text.upper())
    if set(body) <= set("SV9P"):
        whole, _, part = body.replace("S", "").partition("V")
        left, right = len(body.replace("S", "")) - len(body.replace("S", "").lstrip("P")), len(whole) - len(whole.rstrip("P"))
        return Picture(text, "numeric", body.startswith("S"), whole.count("9"), part.count("9"), right or -left, body.count("9"))
    if set(body) <= {"A"}:
        return Picture(text, "alphabetic", size=len(body))
    if set(body) <= set("XA9"):
        return Picture(text, "alphanumeric", size=len(body))
    whole, _, part = body.partition(".") if "." in body else body.partition("V")
    count = lambda s: sum(c in "9Z*" for c in s)
    return Picture(text, "edited", body[:1] in "+-" or body[-2:] in ("CR", "DB") or body[-1:] in "+-", count(whole), count(part), 0, len(body.replace("V", "")))


#: Usages by their spellings.
USAGES = {
    "COMP": "binary", "COMP-4": "binary", "BINARY": "binary", "COMPUTATIONAL": "binary", "COMP-5": "native", "COMP-1": "float", "COMP-2": "double",
    "COMP-3": "packed", "PACKED-DECIMAL": "packed", "COMPUTATIONAL-3": "packed", "DISPLAY": "display", "INDEX": "index", "POINTER": "pointer",
}


def bytes_required(picture: Picture | None, usage: str, separate: bool = False) -> int:
    if usage in ("float", "index"):
        return 4
    if usage in ("double", "pointer"):
        return 8
    digits = picture.digits if picture else 0
    if usage == "packed":
        return codecs.packed_length(digits)
    if usage in ("binary", "native"):
        return 2 if digits <= 4 else 4 if digits <= 9 else 8
    return picture.size + separate


@dataclass
class Item:
    level: int
    name: str
    picture: Picture | None = None
    usage: str = "display"
    occurs: int = 1
    at_least: int = 0
    depending: str | None = None
    redefines: str | None = None
    renames: tuple[str, str] | None = None
    value: str | None = None
    sign: tuple[bool, bool] | None = None  #: (leading, separate)
    justified: bool = False
    blank_when_zero: bool = False
    conditions: dict[str, list] = field(default_factory=dict)  #: 88-level names
    children: list[Item] = field(default_factory=list)
    offset: int = 0

    @property
    def size(self) -> int:
        """Bytes of one occurrence."""
        if self.picture is None and self.usage not in ("float", "double", "index", "pointer"):
            return sum(c.size * c.occurs for c in self.children if not c.redefines and not c.renames)
        return bytes_required(self.picture, self.usage, bool(self.sign and self.sign[1]))

    def place(self, offset: int = 0) -> Item:
        self.offset, at, starts = offset, offset, {}
        for c in self.children:
            if c.renames:
                continue
            c.place(starts.get(c.redefines, at) if c.redefines else at)
            starts[c.name] = c.offset
            if not c.redefines:
                at += c.size * c.occurs
        return self

    def walk(self, path: str = "") -> Iterator[tuple[str, Item]]:
        path = f"{path}.{self.name}" if path else self.name
        yield path, self
        for c in self.children:
            yield from c.walk(path)


WORD = re.compile(r"""'[^']*'|"[^"]*"|[^\s,;]+""")


def _literal(text: str) -> object:
    if text[0] in "'\"":
        return text[1:-1]
    figurative = {"ZERO": 0, "ZEROS": 0, "ZEROES": 0, "SPACE": " ", "SPACES": " "}
    if text.upper() in figurative:
        return figurative[text.upper()]
    return (float(text) if "." in text else int(text)) if re.fullmatch(r"[+-]?\d+(\.\d+)?", text) else text


def _sentences(source: str) -> Iterator[list[str]]:
    """Words of each sentence; columns 1-6 and 73-80 and comment lines of fixed format are left out."""
    lines = []
    for line in source.splitlines():
        if re.match(r"^.{6}[*/]", line) or line.lstrip().startswith("*"):
            continue
        lines.append(line[7:72] if re.match(r"^(\d{6}| {6})[ -]", line) else line.split("*>")[0])
    text = "\n".join(lines)
    words: list[str] = []
    for match in WORD.finditer(text):
        word = match[0]
        ended = word.endswith(".") and word[0] not in "'\""
        words.append(word.rstrip(".") if ended else word)
        if ended or text[match.end() : match.end() + 1] == ".":
            yield [w for w in words if w and w != "."]
            words = []
    if words:
        yield words


def _condition(words: list[str]) -> tuple[str, list]:
    values: list = []
    rest = [w for w in words[2:] if w.upper() not in ("VALUE", "VALUES", "IS", "ARE")]
    k = 0
    while k < len(rest):
        if rest[k].upper() in ("WHEN", "FALSE"):
            break
        if k + 2 < len(rest) and rest[k + 1].upper() in ("THRU", "THROUGH"):
            values.append((_literal(rest[k]), _literal(rest[k + 2])))
            k += 3
        else:
            values.append(_literal(rest[k]))
            k += 1
    return words[1].upper(), values


def _item(words: list[str]) -> Item:
    upper = [w.upper() for w in words]
    named = len(words) > 1 and upper[1] not in ("PIC", "PICTURE", "REDEFINES", "OCCURS", "VALUE", "USAGE") and upper[1] not in USAGES
    item, k = Item(int(words[0]), upper[1] if named else "FILLER"), 2 if named else 1
    while k < len(words):
        word = upper[k]
        after = lambda skip: next((j for j in range(k + 1, len(words)) if upper[j] not in skip), len(words))  # noqa: B023, E731
        if word in ("PIC", "PICTURE"):
            k = after({"IS"})
            item.picture = parse_picture(words[k])
        elif word in USAGES:
            item.usage = USAGES[word]
        elif word == "REDEFINES":
            item.redefines = upper[k := k + 1]
        elif word == "RENAMES":
            first = upper[k + 1]
            through = k + 3 < len(words) and upper[k + 2] in ("THRU", "THROUGH")
            item.renames = (first, upper[k + 3] if through else first)
            k += 3 if through else 1
        elif word == "OCCURS":
            item.occurs = int(words[k := k + 1])
            if k + 2 < len(words) and upper[k + 1] == "TO":
                item.at_least, item.occurs = item.occurs, int(words[k + 2])
                k += 2
        elif word == "DEPENDING":
            item.depending = upper[k := after({"ON"})]
        elif word in ("VALUE", "VALUES"):
            k = after({"IS"})
            item.value = _literal(words[k])
        elif word in ("LEADING", "TRAILING"):
            item.sign = (word == "LEADING", bool(item.sign and item.sign[1]))
        elif word == "SEPARATE":
            item.sign = (bool(item.sign and item.sign[0]), True)
        elif word in ("JUST", "JUSTIFIED"):
            item.justified = True
        elif word == "BLANK":
            item.blank_when_zero = True
        k += 1
    return item


def parse(source: str) -> list[Item]:
    """The records (levels 01 and 77, and bare items) of a copybook, with offsets."""
    roots: list[Item] = []
    stack: list[Item] = []
    last: Item | None = None
    for words in _sentences(source):
        if not words or not words[0].isdigit():
            continue
        level = int(words[0])
        if level == 88:
            name, values = _condition(words)
            last.conditions[name] = values
            continue
        item = _item(words)
        if level == 66:
            roots[-1].children.append(item)
            continue
        while stack and (stack[-1].level >= level or level in (1, 77)):
            stack.pop()
        (stack[-1].children if stack else roots).append(item)
        stack.append(item)
        last = item
    seen: dict[str, int] = {}
    for root in roots:
        for _, item in root.walk():
            if item.name == "FILLER":
                seen["FILLER"] = seen.get("FILLER", 0) + 1
                item.name = f"FILLER-{seen['FILLER']}"
        root.place()
    return roots


def flatten(spark: SparkSession, roots: list[Item]) -> DataFrame:
    """(position, path, level, picture, usage, offset, length, occurs) of every item, in source order."""
    rows = [(k, path, i.level, i.picture.text if i.picture else None, i.usage, i.offset, i.size, i.occurs) for k, (path, i) in enumerate((p, i) for r in roots for p, i in r.walk())]
    return spark.createDataFrame(rows, "position int, path string, level int, picture string, usage string, offset int, length int, occurs int")


ITEMS = "position int, path string, level int, picture string, usage string, offset int, length int, occurs int"


def items_of(sources: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, path, …) of every item of the copybooks that are the rows of a frame, one copybook a row; as
    flatten() gives them. A text that is no copybook has no items.

    Texts are dealt over all tasks, however few files or row groups they come from, and a text that many rows share is
    parsed once."""
    spark = sources.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    texts = sources.select(F.col(text).alias("_text")).filter("_text is not null").repartition(n).distinct()
    parsed = settled(texts.repartition(4 * n).mapInArrow(_parsed, f"_text string, _items array<struct<{', '.join(f.replace(' ', ': ', 1) for f in ITEMS.split(', '))}>>"))
    rows = sources.select(key, F.col(text).alias("_text")).repartition(n)
    return rows.join(parsed, "_text").select(key, F.inline("_items"))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copybooks with their items."""
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    names = [f.split()[0] for f in ITEMS.split(", ")]
    for batch in batches:
        rows, ends = [], [0]
        for source in batch[0].to_pylist():
            items = [(path, i) for r in parse(source) for path, i in r.walk()]
            rows += [(k, path, i.level, i.picture.text if i.picture else None, i.usage, i.offset, i.size, i.occurs) for k, (path, i) in enumerate(items)]
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
        items = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)
        yield pa.RecordBatch.from_arrays([batch[0], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)], ["_text", "_items"])


#: Occurrences of a table that are written out one by one.
UNROLLED = 64


def column_name(name: str) -> str:
    return name.lower().replace("-", "_")


def _decode(item: Item, data: Column, ebcdic: bool) -> Column:
    p, usage = item.picture, item.usage
    if usage in ("float", "double"):
        return codecs.decode_float(data, item.size)
    if usage in ("index", "pointer"):
        return codecs.decode_binary(data, item.size)
    if p.kind != "numeric":
        return codecs.decode_ebcdic(data) if ebcdic else codecs.decode_text(data)
    if usage == "packed":
        value = codecs.decode_packed(data, p.digits, p.decimals)
    elif usage in ("binary", "native"):
        value = codecs.decode_binary(data, item.size, p.signed, p.decimals)
    elif item.sign and item.sign[1]:
        text = codecs.decode_ebcdic(data) if ebcdic else codecs.decode_text(data)
        value = codecs.decode_separate_sign(text, p.digits, p.decimals, item.sign[0])
    elif item.sign and item.sign[0]:
        text = codecs.decode_ebcdic(data) if ebcdic else codecs.decode_text(data)
        value = codecs.decode_overpunch(text, p.digits, p.decimals, True)
    else:
        value = codecs.decode_zoned(data, p.digits, p.decimals, p.signed)
    if p.scaling:
        shift = p.scaling if p.scaling > 0 else p.scaling - p.digits
        return (value * F.lit(10.0**shift)).cast(f"decimal(38,{max(-shift, 0)})")
    return value.cast(spark_type(item))


def spark_type(item: Item) -> str:
    p = item.picture
    if item.usage in ("float", "double"):
        return item.usage
    if item.usage in ("index", "pointer"):
        return "int" if item.usage == "index" else "bigint"
    if p.kind != "numeric":
        return "string"
    if p.decimals or p.digits > 18:
        return f"decimal({p.digits},{p.decimals})"
    return "smallint" if p.digits <= 4 else "int" if p.digits <= 9 else "bigint"


def _reading(item: Item, record: Column, base: Column | int, ebcdic: bool) -> Column:
    """The item at byte offset ``base`` of the record."""
    if item.occurs > 1:
        one = Item(**{**item.__dict__, "occurs": 1})
        if item.occurs <= UNROLLED:  # stays in generated code
            return F.array(*[_reading(one, record, base + k * item.size, ebcdic) for k in range(item.occurs)])
        count = F.lit(item.occurs)
        begin = F.lit(base) if isinstance(base, int) else base
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: _reading(one, record, begin + k * item.size, ebcdic))
    if item.children:
        return F.struct(*[_reading(c, record, base + (c.offset - item.offset), ebcdic).alias(column_name(c.name)) for c in item.children if not c.renames])
    at = F.lit(base + 1) if isinstance(base, int) else base + 1
    return _decode(item, F.substr(record, at, F.lit(item.size)), ebcdic)


def decode(df: DataFrame, root: Item, record: str = "record", ebcdic: bool = False) -> DataFrame:
    """The columns of ``df`` without ``record``, then one column for each child of ``root``."""
    columns, names = [], {i.name: i for _, i in root.walk()}
    for c in root.children:
        if c.renames:
            first, last = names[c.renames[0]], names[c.renames[1]]
            span = F.substr(F.col(record), F.lit(first.offset + 1), F.lit(last.offset + last.size * last.occurs - first.offset))
            columns.append((codecs.decode_ebcdic(span) if ebcdic else codecs.decode_text(span)).alias(column_name(c.name)))
            continue
        value = _reading(c, F.col(record), c.offset, ebcdic)
        if c.depending:
            counter = names[c.depending]
            value = F.slice(value, F.lit(1), F.greatest(_reading(counter, F.col(record), counter.offset, ebcdic).cast("int"), F.lit(0)))
        columns.append(value.alias(column_name(c.name)))
    return df.select(*[F.col(x) for x in df.columns if x != record], *columns)


def _bytes(item: Item, value: Column, ebcdic: bool) -> Column:
    p, usage = item.picture, item.usage
    if item.occurs > 1:
        one = Item(**{**item.__dict__, "occurs": 1})
        if item.occurs <= UNROLLED:
            every = F.concat(*[_bytes(one, F.get(value, F.lit(k)), ebcdic) for k in range(item.occurs)])
            there = F.substr(every, F.lit(1), F.size(value) * item.size)  # bytes of zero for what is not there
            return F.when(value.isNotNull(), F.call_function("rpad", there, F.lit(item.size * item.occurs), F.lit(b"\0")))
        hexes = F.transform(value, lambda v: F.hex(_bytes(one, v, ebcdic)))
        return F.unhex(F.rpad(F.array_join(hexes, ""), 2 * item.size * item.occurs, "0"))
    if item.children:
        return F.concat(*[_bytes(c, value[column_name(c.name)], ebcdic) for c in item.children if not c.redefines and not c.renames])
    text = lambda v: codecs.encode_ebcdic(v, item.size) if ebcdic else F.encode(F.rpad(v, item.size, " "), "ISO-8859-1")
    if p is None or p.kind != "numeric":
        return text(codecs.justified_right(F.coalesce(value, F.lit("")), item.size) if item.justified else F.coalesce(value, F.lit("")))
    number = F.coalesce(value.cast(f"decimal({max(p.digits, 1)},{p.decimals})"), F.lit(0))
    if usage == "packed":
        return codecs.encode_packed(number, p.digits, p.decimals, exact=True)
    if usage in ("binary", "native"):
        return codecs.encode_binary(number, item.size, p.decimals, exact=True)
    if item.sign and item.sign[1]:
        return text(codecs.encode_separate_sign(number, p.digits, p.decimals, item.sign[0]))
    if item.sign and item.sign[0]:
        return text(codecs.encode_overpunch(number, p.digits, p.decimals, True))
    return codecs.encode_zoned(number, p.digits, p.decimals, p.signed, 0xF if ebcdic else 0x3, exact=True)


def encode(df: DataFrame, root: Item, record: str = "record", ebcdic: bool = False) -> DataFrame:
    """One binary column: the record of each row, whose columns are named as decode() names them."""
    parts = [_bytes(c, F.col(column_name(c.name)), ebcdic) for c in root.children if not c.redefines and not c.renames]
    return df.select(F.concat(*parts).alias(record))


def condition_columns(root: Item) -> dict[str, Column]:
    """A boolean expression for each 88-level name, over the columns decode() gives."""
    from recordloom.functions.expressions import condition_name

    out = {}
    for path, item in root.walk():
        for name, values in item.conditions.items():
            reference = ".".join(column_name(p) for p in path.split(".")[1:])
            out[name] = condition_name(F.col(reference), values)
    return out
