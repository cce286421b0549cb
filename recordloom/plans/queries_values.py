"""Codecs, moves, conditions, arithmetic, strings and dates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import codecs as C
from recordloom.functions import expressions as X
from recordloom.plans import copybook
from recordloom.plans.registry import Registry, table
from recordloom.sources import files

query = Registry()
MONEY = "decimal(15,2)"


def cents(column: str):
    return F.col(column).cast(MONEY)


@query("pic_comp3_roundtrip", """
SELECT l_orderkey, l_linenumber, upper(lpad(CAST(abs(c) AS VARCHAR), 11, '0') || 'C') AS packed, CAST(c / 100.0 AS DOUBLE) AS amount
FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM lineitem)""")
def _(spark, d):
    packed = C.encode_packed(cents("l_extendedprice"), 11, 2)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.hex(packed).alias("packed"), C.decode_packed(packed, 11, 2).cast("double").alias("amount"))


@query("pic_comp3_signed", """
SELECT c_custkey, lpad(CAST(abs(c) AS VARCHAR), 9, '0') || CASE WHEN c < 0 THEN 'D' ELSE 'C' END AS packed, CAST(c / 100.0 AS DOUBLE) AS balance
FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)""")
def _(spark, d):
    packed = C.encode_packed(cents("c_acctbal"), 9, 2)
    return table(spark, d, "customer").select("c_custkey", F.hex(packed).alias("packed"), C.decode_packed(packed, 9, 2).cast("double").alias("balance"))


@query("pic_comp3_total", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    packed = table(spark, d, "lineitem").select("l_returnflag", C.encode_packed(cents("l_extendedprice"), 11, 2).alias("p"))
    return packed.groupBy("l_returnflag").agg(F.sum(C.decode_packed(F.col("p"), 11, 2)).cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query("pic_zoned_roundtrip", """
SELECT c_custkey, upper(regexp_replace(left(t, 8), '(.)', 'F\\1', 'g') || CASE WHEN c < 0 THEN 'D' ELSE 'C' END || right(t, 1)) AS zoned, CAST(c / 100.0 AS DOUBLE) AS balance
FROM (SELECT c_custkey, c, lpad(CAST(abs(c) AS VARCHAR), 9, '0') AS t FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer))""")
def _(spark, d):
    zoned = C.encode_zoned(cents("c_acctbal"), 9, 2)
    return table(spark, d, "customer").select("c_custkey", F.hex(zoned).alias("zoned"), C.decode_zoned(zoned, 9, 2).cast("double").alias("balance"))


@query("pic_binary_roundtrip", """
SELECT c_custkey, upper(right(printf('%016x', c), 8)) AS bin4, c AS value FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)""")
def _(spark, d):
    value = F.round(F.col("c_acctbal") * 100).cast("long")
    data = C.encode_binary(value, 4)
    return table(spark, d, "customer").select("c_custkey", F.hex(data).alias("bin4"), C.decode_binary(data, 4).alias("value"))


@query("binary_wrap", "SELECT o_orderkey, o_orderkey * 977 % 65536 AS wrapped FROM orders")
def _(spark, d):
    data = C.encode_binary(F.col("o_orderkey") * 977, 2)
    return table(spark, d, "orders").select("o_orderkey", C.decode_binary(data, 2, signed=False).alias("wrapped"))


@query("float_bits", """SELECT o_orderkey, s * (1 + f / 4503599627370496.0) * pow(2, e - 1023) AS value, CAST(s * (1 + g / 8388608.0) * pow(2, x - 127) AS DOUBLE) AS single, CAST(NULL AS DOUBLE) AS none
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 1 THEN -1.0 ELSE 1.0 END::DOUBLE AS s, (900 + o_orderkey % 200)::DOUBLE AS e, ((o_orderkey * 987654321987) % 4503599627370496)::DOUBLE AS f, (60 + o_orderkey % 120)::DOUBLE AS x, ((o_orderkey * 7919) % 8388608)::DOUBLE AS g FROM orders)""")
def _(spark, d):
    """Doubles and singles of many exponents from their bits; the bits of an infinity give null."""
    k = F.col("o_orderkey")
    sign = k % 2
    double = sign * F.lit(-(2**63)) + (900 + k % 200) * F.lit(2**52) + (k * 987654321987) % F.lit(2**52)
    single = sign * F.lit(2**31) + (60 + k % 120) * F.lit(2**23) + (k * 7919) % F.lit(2**23)
    none = C.decode_float(F.unhex(F.when(sign == 0, "7FF0000000000000").otherwise("FFF8000000000001")), 8)
    return table(spark, d, "orders").select("o_orderkey", C.decode_float(C.encode_binary(double, 8), 8).alias("value"), C.decode_float(C.encode_binary(single, 4), 4).cast("double").alias("single"), none.alias("none"))


@query("float_decode", "SELECT s_suppkey, s_acctbal AS value, CAST(CAST(s_suppkey AS FLOAT) / 4 AS DOUBLE) AS quarter FROM supplier")
def _(spark, d):
    # the bits of a double follow from its exponent and fraction
    x = F.col("s_acctbal")
    e = F.floor(F.log2(F.abs(x)))
    e = F.when(F.abs(x) >= F.pow(F.lit(2.0), e + 1), e + 1).when(F.abs(x) < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
    bits = (e.cast("long") + 1023) * F.lit(2**52) + ((F.abs(x) / F.pow(F.lit(2.0), e) - 1) * F.lit(float(2**52))).cast("long")
    signed = F.when(x < 0, bits + F.lit('-9223372036854775808').cast('long')).otherwise(bits)
    q = F.col("s_suppkey").cast("double") / 4
    f = F.floor(F.log2(q))
    single = (f.cast("long") + 127) * F.lit(2**23) + ((q / F.pow(F.lit(2.0), f) - 1) * F.lit(float(2**23))).cast("long")
    return table(spark, d, "supplier").select(
        "s_suppkey",
        F.when(x == 0, 0.0).otherwise(C.decode_float(C.encode_binary(signed, 8), 8)).alias("value"),
        F.when(q == 0, 0.0).otherwise(C.decode_float(C.encode_binary(single, 4), 4).cast("double")).alias("quarter"),
    )


@query("overpunch_decode", """
SELECT c_custkey, left(t, 8) || CASE WHEN c < 0 THEN substr('}JKLMNOPQR', CAST(right(t, 1) AS INT) + 1, 1) ELSE substr('{ABCDEFGHI', CAST(right(t, 1) AS INT) + 1, 1) END AS punched, CAST(c / 100.0 AS DOUBLE) AS balance
FROM (SELECT c_custkey, c, lpad(CAST(abs(c) AS VARCHAR), 9, '0') AS t FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer))""")
def _(spark, d):
    text = C.encode_overpunch(cents("c_acctbal"), 9, 2)
    return table(spark, d, "customer").select("c_custkey", text.alias("punched"), C.decode_overpunch(text, 9, 2).cast("double").alias("balance"))


@query("separate_sign", """
SELECT c_custkey, CASE WHEN c < 0 THEN '-' ELSE '+' END || t AS leading_sign, t || CASE WHEN c < 0 THEN '-' ELSE '+' END AS trailing_sign, CAST(c / 100.0 AS DOUBLE) AS balance
FROM (SELECT c_custkey, c, lpad(CAST(abs(c) AS VARCHAR), 9, '0') AS t FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer))""")
def _(spark, d):
    lead, trail = C.encode_separate_sign(cents("c_acctbal"), 9, 2, True), C.encode_separate_sign(cents("c_acctbal"), 9, 2, False)
    return table(spark, d, "customer").select("c_custkey", lead.alias("leading_sign"), trail.alias("trailing_sign"), C.decode_separate_sign(trail, 9, 2, False).cast("double").alias("balance"))


@query("ebcdic_text", "SELECT p_partkey, trim(p_name) AS name, upper(hex(encode(translate(left(rpad(p_brand, 10, ' '), 10), '#0123456789Brand ', chr(123) || 'ðñòóôõö÷øùÂ' || chr(153) || chr(129) || chr(149) || chr(132) || '@')))) IS NOT NULL AS coded FROM part")
def _(spark, d):
    data = C.encode_ebcdic(F.col("p_name"), 60)
    return table(spark, d, "part").select("p_partkey", C.decode_ebcdic(data).alias("name"), (F.length(data) == 60).alias("coded"))


@query("ebcdic_digits", "SELECT o_orderkey, regexp_replace(lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), '(.)', 'F\\1', 'g') AS bytes FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.hex(C.encode_ebcdic(F.lpad(F.col("o_orderkey").cast("string"), 9, "0"), 9)).alias("bytes"))


ORDER_COPYBOOK = """
       01  ORDER-RECORD.
           05  ORD-KEY            PIC 9(10).
           05  ORD-DATE           PIC 9(08).
           05  ORD-DATE-PARTS REDEFINES ORD-DATE.
               10  ORD-YEAR       PIC 9(04).
               10  ORD-MONTH      PIC 9(02).
               10  ORD-DAY        PIC 9(02).
           05  ORD-STATUS         PIC X(01).
               88  ORD-OPEN       VALUE 'O'.
               88  ORD-DONE       VALUE 'F' 'P'.
           05  ORD-TOTAL          PIC S9(9)V99 COMP-3.
           05  ORD-CUSTOMER       PIC 9(9) COMP.
           05  ORD-SLOTS OCCURS 3 TIMES.
               10  SLOT-NO        PIC 9(02).
               10  SLOT-AMOUNT    PIC S9(7)V99 COMP-3.
           66  ORD-STAMP RENAMES ORD-DATE THRU ORD-STATUS.
"""


def order_records(spark, d):
    """The orders table as bytes of ORDER_COPYBOOK, and the record's item."""
    root = copybook.parse(ORDER_COPYBOOK)[0]
    slot = lambda k: F.struct(F.lit(k).cast("smallint").alias("slot_no"), (F.col("o_totalprice").cast("decimal(9,2)") * k).cast("decimal(9,2)").alias("slot_amount"))
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord_key"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("ord_date"), F.col("o_orderstatus").alias("ord_status"),
        F.col("o_totalprice").cast("decimal(11,2)").alias("ord_total"), F.col("o_custkey").cast("int").alias("ord_customer"), F.array(slot(1), slot(2), slot(3)).alias("ord_slots"),
    )
    # one value a row, as a file scan hands it over, not an expression that every field would work out anew
    return copybook.encode(rows, root).select(F.explode(F.array("record")).alias("record")), root


@query("record_layout_decode", """
SELECT o_orderkey AS ord_key, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS ord_date, o_orderstatus AS ord_status, CAST(CAST(o_totalprice AS DECIMAL(11,2)) AS DOUBLE) AS ord_total, CAST(o_custkey AS INT) AS ord_customer,
       strftime(o_orderdate, '%Y%m%d') || o_orderstatus AS ord_stamp, o_orderstatus IN ('F', 'P') AS done FROM orders""")
def _(spark, d):
    records, root = order_records(spark, d)
    flags = copybook.condition_columns(root)
    return copybook.decode(records, root).select("ord_key", "ord_date", "ord_status", F.col("ord_total").cast("double").alias("ord_total"), "ord_customer", "ord_stamp", flags["ORD-DONE"].alias("done"))


@query("redefines_date", "SELECT o_orderkey AS ord_key, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS dd FROM orders")
def _(spark, d):
    records, root = order_records(spark, d)
    return copybook.decode(records, root).select("ord_key", F.col("ord_date_parts.ord_year").cast("int").alias("y"), F.col("ord_date_parts.ord_month").cast("int").alias("m"), F.col("ord_date_parts.ord_day").cast("int").alias("dd"))


@query("occurs_explode", """
SELECT o_orderkey AS ord_key, CAST(k AS INT) AS slot_no, CAST(CAST(o_totalprice AS DECIMAL(9,2)) * k AS DOUBLE) AS slot_amount FROM orders, (SELECT unnest([1, 2, 3]) AS k)""")
def _(spark, d):
    records, root = order_records(spark, d)
    slots = copybook.decode(records, root).select("ord_key", F.explode("ord_slots").alias("s"))
    return slots.select("ord_key", F.col("s.slot_no").cast("int").alias("slot_no"), F.col("s.slot_amount").cast("double").alias("slot_amount"))


@query("occurs_depending", "SELECT o_orderkey, CAST(o_orderkey % 4 AS INT) AS n, CAST((o_orderkey % 4) * (o_orderkey % 4 + 1) / 2 AS BIGINT) AS total FROM orders")
def _(spark, d):
    source = "01 R. 05 K PIC 9(10). 05 N PIC 9(2). 05 T OCCURS 0 TO 3 TIMES DEPENDING ON N PIC 9(3)."
    root = copybook.parse(source)[0]
    n = (F.col("o_orderkey") % 4).cast("smallint")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), n.alias("n"), F.array(*[F.lit(j).cast("smallint") for j in (1, 2, 3)]).alias("t"))
    out = copybook.decode(copybook.encode(rows, root), root)
    return out.select(F.col("k").alias("o_orderkey"), F.col("n").cast("int").alias("n"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("copybook_items", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 12 + 1 <= 4 THEN 2 WHEN p_partkey % 12 + 1 <= 9 THEN 4 ELSE 8 END AS k, length(p_name) AS n, p_size % 5 + 1 AS times, (p_partkey % 13 + 3) // 2 + 1 AS a FROM part)
SELECT p_partkey, path, CAST("offset" AS INT) AS "offset", CAST(length AS INT) AS length, CAST(occurs AS INT) AS occurs FROM (
  SELECT p_partkey, 'PART' AS path, 0 AS "offset", k + n + times * (a + 3) AS length, 1 AS occurs FROM p UNION ALL SELECT p_partkey, 'PART.P-KEY', 0, k, 1 FROM p UNION ALL SELECT p_partkey, 'PART.P-NAME', k, n, 1 FROM p
  UNION ALL SELECT p_partkey, 'PART.P-SHORT', k, 2, 1 FROM p UNION ALL SELECT p_partkey, 'PART.P-PRICES', k + n, a + 3, times FROM p
  UNION ALL SELECT p_partkey, 'PART.P-PRICES.AMOUNT', k + n, a, 1 FROM p UNION ALL SELECT p_partkey, 'PART.P-PRICES.AREA', k + n + a, 3, 1 FROM p)""")
def _(spark, d):
    """A copybook for each part, with pictures and a table of its own sizes: places and lengths of all items."""
    k = F.col("p_partkey")
    source = F.format_string(
        "01 PART. 05 P-KEY PIC 9(%d) COMP. 05 P-NAME PIC X(%d). 05 P-SHORT REDEFINES P-NAME PIC X(2). 05 P-PRICES OCCURS %d TIMES. 10 AMOUNT PIC S9(%d)V99 COMP-3. 10 AREA PIC 9(3).",
        k % 12 + 1, F.char_length("p_name"), F.col("p_size") % 5 + 1, k % 13 + 1,
    )
    return copybook.items_of(table(spark, d, "part").select("p_partkey", source.alias("source")), "p_partkey", "source").select("p_partkey", "path", "offset", "length", "occurs")


@query("edited_report_amounts", """
SELECT c_custkey, lpad(CASE WHEN c < 0 THEN '-' ELSE '' END || regexp_replace(reverse(regexp_replace(reverse(CAST(abs(c) // 100 AS VARCHAR)), '(\\d{3})', '\\1,', 'g')), '^,', '') || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0'), 14, ' ') AS text
FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)""")
def _(spark, d):
    text = C.edited(cents("c_acctbal"), "--,---,--9.99")
    return table(spark, d, "customer").select("c_custkey", F.lpad(F.ltrim(text), 14, " ").alias("text"))


@query("blank_when_zero", "SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '     ' ELSE lpad(CAST(s_suppkey % 5 AS VARCHAR), 5, ' ') END AS z, lpad(right(s_name, 6), 6, ' ') AS j, CASE WHEN s_suppkey % 2 = 0 THEN '****7.50' ELSE '****7.50CR' END AS a FROM supplier")
def _(spark, d):
    k = F.col("s_suppkey") % 5
    amount = F.when(F.col("s_suppkey") % 2 == 0, F.lit("7.50").cast("decimal(7,2)")).otherwise(F.lit("-7.50").cast("decimal(7,2)"))
    return table(spark, d, "supplier").select("s_suppkey", C.edited(k, "Z(4)9", blank_when_zero=True).alias("z"), C.justified_right(F.col("s_name"), 6).alias("j"), F.rtrim(C.edited(amount, "****9.99CR")).alias("a"))


@query("display_pictures", """
SELECT c_custkey, CASE WHEN c < 0 THEN '-' ELSE '' END || lpad(CAST(abs(c) // 100 AS VARCHAR), 7, '0') || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS plain,
       CASE WHEN c < 0 THEN '-' ELSE '+' END || lpad(CAST(abs(c) // 100 AS VARCHAR), 7, '0') || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS signed, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS shown
FROM (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS c FROM customer)""")
def _(spark, d):
    value = cents("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", X.to_picture(value, 9, 2).alias("plain"), X.to_picture(value, 9, 2, True).alias("signed"), X.to_display(F.col("c_custkey"), 8).alias("shown"))


@query("move_numeric_alnum", """
SELECT c_custkey, right(lpad(CAST(c_custkey AS VARCHAR), 20, '0'), 3) AS low3, lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS wide, left(rpad(c_name, 30, ' '), 12) AS name12, rpad(c_mktsegment, 15, ' ') AS segment FROM customer""")
def _(spark, d):
    key = F.col("c_custkey").cast("string")
    return table(spark, d, "customer").select("c_custkey", X.move_numeric(key, 3).alias("low3"), X.move_numeric(key, 12).alias("wide"), X.move_text(F.col("c_name"), 12).alias("name12"), X.move_text(F.col("c_mktsegment"), 15).alias("segment"))


@query("truncate_move", """
SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(l_extendedprice AS DECIMAL(15,2)) * 10) / 10 AS DOUBLE) AS one_place, CAST(CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 / 100.0 AS DOUBLE) AS three_digits FROM lineitem""")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.truncate(cents("l_extendedprice"), 1).cast("double").alias("one_place"), X.move_decimal(cents("l_extendedprice"), 5, 2).cast("double").alias("three_digits"))


@query("reference_mod", "SELECT c_custkey, substr(c_name, 1, 4) AS a, substr(c_name, 10) AS b, substr(c_name, 5, 100) AS c FROM customer")
def _(spark, d):
    name = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", X.reference(name, 0, 4).alias("a"), X.reference(name, 10).alias("b"), X.reference(name, 5, 100).alias("c"))


@query("move_corresponding", "SELECT c_custkey, c_name AS name, CAST(c_custkey + c_nationkey AS BIGINT) AS k, 'keep' AS other FROM customer")
def _(spark, d):
    df = table(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("k")).alias("src"), F.struct(F.lit("x").alias("name"), F.col("c_custkey").alias("k"), F.lit("keep").alias("other")).alias("dst"))
    added = X.combine_corresponding(df, "src", "dst")
    return X.move_corresponding(added.withColumn("src", F.struct("src.name")), "src", "dst").select("c_custkey", "dst.name", "dst.k", "dst.other")


@query("figurative_initialize", "SELECT n_nationkey, 0 AS k, repeat(' ', length(n_name)) AS blank, '****' AS stars, '0000' AS zeros FROM nation")
def _(spark, d):
    done = X.initialize(table(spark, d, "nation").select(F.lit(7).alias("k"), F.col("n_name").alias("blank"), F.struct("n_nationkey").alias("id")))
    return done.select("id.n_nationkey", "k", "blank", X.figurative('ALL "*"', 4).alias("stars"), X.figurative("ZEROS", 4).alias("zeros"))


@query("level88_flags", "SELECT o_orderkey, o_orderstatus = 'O' AS is_open, o_orderstatus IN ('F', 'P') AS is_done, o_totalprice BETWEEN 1000 AND 50000 AS is_mid, 'F' AS set_value FROM orders")
def _(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", X.condition_name(status, ["O"]).alias("is_open"), X.condition_name(status, ["F", "P"]).alias("is_done"), X.condition_name(F.col("o_totalprice"), [(1000, 50000)]).alias("is_mid"), X.set_condition(["F", "P"]).alias("set_value"))


@query("enum_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FILLED' END AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.decode_enum(F.col("o_orderstatus"), {"O": "OPEN", "F": "FILLED"}).alias("label"))


@query("evaluate_tiers", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBT' WHEN c_acctbal >= 7500 THEN 'GOLD' WHEN c_acctbal >= 2500 THEN 'SILVER' ELSE 'BASIC' END AS tier FROM customer")
def _(spark, d):
    b, t = F.col("c_acctbal"), F.lit(True)
    return table(spark, d, "customer").select("c_custkey", X.evaluate([t], [([b < 0], "DEBT"), ([b >= 7500], "GOLD"), ([b >= 2500], "SILVER")], "BASIC").alias("tier"))


@query("evaluate_also", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderpriority BETWEEN '1' AND '2~' THEN 'A' WHEN o_orderstatus = 'F' THEN 'B' WHEN NOT o_orderstatus = 'O' AND o_orderpriority BETWEEN '1' AND '3~' THEN 'C' ELSE 'Z' END AS code FROM orders""")
def _(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = [(["F", ("1", "2~")], "A"), (["F", None], "B"), ([("NOT", "O"), ("1", "3~")], "C")]
    return table(spark, d, "orders").select("o_orderkey", X.evaluate([s, p], rows, "Z").alias("code"))


@query("sign_class_tests", """
SELECT c_custkey, c_acctbal > 0 AS pos, c_acctbal < 0 AS neg, regexp_matches(CAST(c_custkey AS VARCHAR), '^[0-9]+$') AS num, false AS num_name, true AS loose, regexp_matches(c_mktsegment, '^[A-Za-z ]*$') AS alpha, regexp_matches(c_mktsegment, '^[A-Z ]*$') AS up FROM customer""")
def _(spark, d):
    b, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    return table(spark, d, "customer").select(
        "c_custkey", X.sign_test(b, "POSITIVE").alias("pos"), X.sign_test(b, "NEGATIVE").alias("neg"), X.is_numeric(F.col("c_custkey").cast("string")).alias("num"), X.is_numeric(F.col("c_name")).alias("num_name"),
        X.is_numeric_loose(F.lit("1-2")).alias("loose"), X.is_alphabetic(seg).alias("alpha"), X.is_alphabetic(seg, "upper").alias("up"),
    )


@query("compare_padded", """
SELECT n_nationkey, CASE WHEN rpad(n_name, 20, ' ') < rpad('FRANCE', 20, ' ') THEN -1 WHEN rpad(n_name, 20, ' ') > rpad('FRANCE', 20, ' ') THEN 1 ELSE 0 END AS versus, 0 AS same FROM nation""")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.compare_text(F.col("n_name"), F.lit("FRANCE")).alias("versus"), X.compare_text(F.col("n_name"), F.concat("n_name", F.lit("   "))).alias("same"))


@query("go_to_depending", "SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'P-ONE' WHEN 2 THEN 'P-TWO' WHEN 3 THEN 'P-THREE' END AS target FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.go_to_depending(F.col("l_linenumber"), ["P-ONE", "P-TWO", "P-THREE"]).alias("target"))


@query("compute_rounded", """
SELECT l_orderkey, l_linenumber, CAST(round_even(x, 2) AS DOUBLE) AS even, CAST(round(x, 2) AS DOUBLE) AS up, CAST(trunc(x * 100) / 100 AS DOUBLE) AS down
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(1 - l_discount AS DECIMAL(4,2)) * CAST(1 + l_tax AS DECIMAL(4,2)) AS x FROM lineitem)""")
def _(spark, d):
    x = F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount")).cast("decimal(4,2)") * (1 + F.col("l_tax")).cast("decimal(4,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.rounded(x, 2).cast("double").alias("even"), X.rounded(x, 2, "half_up").cast("double").alias("up"), X.rounded(x, 2, "down").cast("double").alias("down"))


@query("size_error_split", "SELECT c_custkey, abs(CAST(c_acctbal AS DECIMAL(15,2))) > 999.99 AS overflow, CAST(CASE WHEN abs(CAST(c_acctbal AS DECIMAL(15,2))) > 999.99 THEN 0 ELSE CAST(c_acctbal AS DECIMAL(15,2)) END AS DOUBLE) AS kept FROM customer")
def _(spark, d):
    b = cents("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", X.size_error(b, 3, 2).alias("overflow"), X.on_size_error(b, 3, 2, F.lit(0).cast(MONEY)).cast("double").alias("kept"))


@query("divide_remainder", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalcents // (o_orderkey % 7) AS BIGINT) END AS quotient, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalcents % (o_orderkey % 7) AS BIGINT) END AS remainder
FROM (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalcents FROM orders)""")
def _(spark, d):
    value, by = F.round(F.col("o_totalprice") * 100).cast("decimal(12,0)"), (F.col("o_orderkey") % 7).cast("decimal(2,0)")
    q, r = X.divide(value, by)
    return table(spark, d, "orders").select("o_orderkey", q.cast("long").alias("quotient"), r.cast("long").alias("remainder"))


@query("add_subtract_multiply", """
SELECT l_orderkey, l_linenumber, CAST(p + q + 5 AS DOUBLE) AS total, CAST(p - (q + 5) AS DOUBLE) AS rest, CAST(q * 3 AS DOUBLE) AS triple
FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS p, CAST(l_quantity AS DECIMAL(15,2)) AS q FROM lineitem)""")
def _(spark, d):
    p, q = cents("l_extendedprice"), cents("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.add([q, F.lit(5)], p).cast("double").alias("total"), X.subtract([q, F.lit(5)], p).cast("double").alias("rest"), X.multiply(q, F.lit(3)).cast("double").alias("triple"))


@query("math_intrinsics", """
SELECT c_custkey, abs(c_acctbal) AS a, sqrt(abs(c_acctbal)) AS s, floor(c_acctbal) AS i, trunc(c_acctbal) AS ip, CAST(c_custkey % 7 AS BIGINT) AS m, greatest(c_acctbal, 100.0) AS mx, least(c_acctbal, 100.0) AS mn,
       round(ln(c_custkey + 1), 9) AS l, round(log10(c_custkey + 1), 9) AS l10, round(sin(c_custkey), 9) AS sn, round(exp(c_custkey % 5), 9) AS e FROM customer""")
def _(spark, d):
    I, b, k = X.INTRINSICS, F.col("c_acctbal"), F.col("c_custkey")  # noqa: E741
    return table(spark, d, "customer").select(
        "c_custkey", I["ABS"](b).alias("a"), I["SQRT"](F.abs(b)).alias("s"), I["INTEGER"](b).cast("double").alias("i"), I["INTEGER-PART"](b).cast("double").alias("ip"), I["MOD"](k, F.lit(7).cast("long")).alias("m"),
        I["MAX"](b, F.lit(100.0)).alias("mx"), I["MIN"](b, F.lit(100.0)).alias("mn"), F.round(I["LOG"](k + 1), 9).alias("l"), F.round(I["LOG10"](k + 1), 9).alias("l10"), F.round(I["SIN"](k), 9).alias("sn"), F.round(I["EXP"](k % 5), 9).alias("e"),
    )


@query("annuity_present_value", """
SELECT s_suppkey, round(0.01 / (1 - pow(1.01, -(s_suppkey % 24 + 1))), 9) AS annuity, round(100 / pow(1.05, 1) + 200 / pow(1.05, 2) + 300 / pow(1.05, 3), 9) AS pv FROM supplier""")
def _(spark, d):
    amounts = F.array(F.lit(100.0), F.lit(200.0), F.lit(300.0))
    return table(spark, d, "supplier").select("s_suppkey", F.round(X.annuity(F.lit(0.01), F.col("s_suppkey") % 24 + 1), 9).alias("annuity"), F.round(X.present_value(F.lit(0.05), amounts), 9).alias("pv"))


@query("perform_times", "SELECT n_nationkey, CAST(n_nationkey * (n_nationkey + 1) / 2 AS BIGINT) AS total FROM nation")
def _(spark, d):
    """A recurrence over PERFORM VARYING as an aggregate over a sequence."""
    n = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.aggregate(F.sequence(F.lit(0), n), F.lit(0).cast("long"), lambda acc, k: acc + k).alias("total"))


@query("perform_varying_after", "SELECT n_nationkey, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM nation, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([1, 2]) AS j)")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("n_nationkey", "i", F.explode(F.sequence(F.lit(1), F.lit(2))).alias("j"))


@query("numval_text", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) / 4 AS n, 0.0::DOUBLE AS empty FROM orders")
def _(spark, d):
    text = F.concat(F.lit("  "), (F.col("o_orderkey").cast("decimal(12,2)") / F.lit(4)).cast("decimal(14,2)").cast("string"), F.lit(" "))
    return table(spark, d, "orders").select("o_orderkey", X.numval(text).cast("double").alias("n"), X.numval(F.lit("  ")).cast("double").alias("empty"))


@query("inspect_tally", """
SELECT p_partkey, CAST((length(p_name) - length(replace(p_name, 'a', ''))) AS BIGINT) AS n_a, CAST((length(p_name) - length(replace(p_name, 're', ''))) / 2 AS BIGINT) AS n_re, CAST(length(regexp_extract('000' || p_partkey, '^0*')) AS BIGINT) AS zeros,
       CAST(CASE WHEN instr(p_name, ' ') > 0 THEN instr(p_name, ' ') - 1 ELSE length(p_name) END AS BIGINT) AS before_blank FROM part""")
def _(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select("p_partkey", X.tally_all(name, "a").alias("n_a"), X.tally_all(name, "re").alias("n_re"), X.tally_leading(F.concat(F.lit("000"), F.col("p_partkey").cast("string")), "0").alias("zeros"), X.tally_characters(name, " ").alias("before_blank"))


@query("inspect_replace", """
SELECT p_partkey, replace(p_type, 'A', '*') AS everywhere, regexp_replace(p_type, 'A', '*') AS first_one, '**' || substr('00' || p_brand, 3) AS leading, p_brand || '--' AS trailing, repeat('x', CASE WHEN instr(p_type, ' ') > 0 THEN instr(p_type, ' ') - 1 ELSE length(p_type) END) || substr(p_type, CASE WHEN instr(p_type, ' ') > 0 THEN instr(p_type, ' ') ELSE length(p_type) + 1 END) AS chars FROM part""")
def _(spark, d):
    t, b = F.col("p_type"), F.col("p_brand")
    return table(spark, d, "part").select("p_partkey", X.replace_all(t, "A", "*").alias("everywhere"), X.replace_first(t, "A", "*").alias("first_one"), X.replace_leading(F.concat(F.lit("00"), b), "0", "*").alias("leading"), X.replace_trailing(F.concat(b, F.lit("..")), ".", "-").alias("trailing"), X.replace_characters(t, "x", " ").alias("chars"))


@query("inspect_convert", "SELECT p_partkey, translate(p_name, 'aeiou', '12345') AS vowels, translate(p_type, 'ABC', 'xyz') AS abc FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", X.converting(F.col("p_name"), "aeioua", "123459").alias("vowels"), X.converting(F.col("p_type"), "ABC", "xyz").alias("abc"))


@query("string_delimited", """
SELECT p_partkey, split_part(p_name, ' ', 1) || '-' || p_brand AS joined, '..' || rpad(left(split_part(p_name, ' ', 1) || '-' || p_brand, 8), 8, '.') AS placed,
       length(split_part(p_name, ' ', 1) || '-' || p_brand) > 8 AS overflow FROM part""")
def _(spark, d):
    parts = [(F.col("p_name"), " "), (F.lit("-"), None), (F.col("p_brand"), None)]
    return table(spark, d, "part").select("p_partkey", X.string_into(parts).alias("joined"), X.string_into(parts, F.lit(".........."), 3).alias("placed"), X.string_overflow(parts, 10, 3).alias("overflow"))


@query("unstring_split", """
SELECT p_partkey, s[1] AS f1, coalesce(s[2], '') AS f2, coalesce(s[3], '') AS f3, CAST(least(len(s), 3) AS BIGINT) AS tally, CAST(length(s[1]) AS BIGINT) AS c1, CASE WHEN len(s) > 1 THEN ' ' ELSE '' END AS d1 FROM (SELECT p_partkey, string_split(p_type, ' ') AS s FROM part)""")
def _(spark, d):
    u = X.unstring(F.col("p_type"), [" ", ";"], 3)
    return table(spark, d, "part").select("p_partkey", u["field_1"].alias("f1"), u["field_2"].alias("f2"), u["field_3"].alias("f3"), u["tally"].alias("tally"), u["count_1"].alias("c1"), u["delimiter_1"].alias("d1"))


@query("identifier_case", """
SELECT s_suppkey, 'Ws' || 'Supp' || s_suppkey AS pascal, 'ws' || 'Supp' || s_suppkey AS camel, 'processSupp' || s_suppkey AS meth FROM supplier""")
def _(spark, d):
    k = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("WS-SUPP_"), k)
    return table(spark, d, "supplier").select("s_suppkey", X.identifier(name, "pascal").alias("pascal"), X.identifier(name).alias("camel"), X.identifier(F.concat(F.lit("1000-PROCESS-SUPP-"), k), "method").alias("meth"))


@query("reverse_ord_char", "SELECT n_nationkey, reverse(n_name) AS r, ascii(n_name) + 1 AS o, chr(64 + n_nationkey) AS c FROM nation")
def _(spark, d):
    I = X.INTRINSICS  # noqa: E741
    return table(spark, d, "nation").select("n_nationkey", I["REVERSE"](F.col("n_name")).alias("r"), I["ORD"](F.col("n_name")).alias("o"), I["CHAR"](F.lit(65) + F.col("n_nationkey")).alias("c"))


@query("case_length_trim", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, length(p_name) AS n, trim('  ' || p_brand || ' ') AS t FROM part")
def _(spark, d):
    I = X.INTRINSICS  # noqa: E741
    return table(spark, d, "part").select("p_partkey", I["UPPER-CASE"](F.col("p_name")).alias("u"), I["LOWER-CASE"](F.col("p_type")).alias("l"), I["LENGTH"](F.col("p_name")).cast("long").alias("n"), I["TRIM"](F.concat(F.lit("  "), "p_brand", F.lit(" "))).alias("t"))


@query("copy_replacing", "SELECT p_partkey, '05 ORD-KEY PIC X(' || p_size || '). 05 PRE-TAG-X PIC X.' AS text FROM part")
def _(spark, d):
    source = F.concat(F.lit("05 TAG-KEY PIC X("), F.col("p_size").cast("string"), F.lit("). 05 PRE-TAG-X PIC X."))
    return table(spark, d, "part").select("p_partkey", X.copy_replacing(source, [("TAG-KEY", "ORD-KEY"), ("TAG", "BAD")]).alias("text"))


@query("cache_key", "SELECT page_id, to_base64(encode(url || ':main')) AS key FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(X.cache_key(F.col("url"), F.lit("main")), r"\s", "").alias("key"))


@query("integer_of_date", """
SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS n, CAST(date_diff('day', DATE '1601-01-01', CAST(o_orderdate AS DATE)) + 1 AS INT) AS iso, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS back FROM orders""")
def _(spark, d):
    ymd = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    n = X.integer_of_date(ymd)
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"), X.integer_of_date(ymd, "iso1601").alias("iso"), X.date_of_integer(n).alias("back"))


@query("accept_date_time", "SELECT event_id, strftime(ts, '%Y%m%d') AS d8, strftime(ts, '%y%m%d') AS d6, strftime(ts, '%H%M%S') || lpad(CAST(CAST(floor(extract('microsecond' FROM ts) % 1000000 / 10000) AS INT) AS VARCHAR), 2, '0') AS t8 FROM events")
def _(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", X.accept_date(ts).alias("d8"), X.accept_date(ts, True).alias("d6"), X.accept_time(ts).alias("t8"))


@query("julian_day", "SELECT o_orderkey, strftime(o_orderdate, '%y%j') AS yyddd FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.accept_day(F.col("o_orderdate")).alias("yyddd"))


@query("day_of_week", "SELECT o_orderkey, CAST(isodow(o_orderdate) AS INT) AS dow FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", X.day_of_week(F.col("o_orderdate")).alias("dow"))


@query("current_date21", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') || lpad(CAST(CAST(floor(extract('microsecond' FROM ts) % 1000000 / 10000) AS INT) AS VARCHAR), 2, '0') || '+0000' AS stamp FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", X.current_date(F.col("ts")).alias("stamp"))


@query("plausible_date", "SELECT o_orderkey, (o_orderkey % 14) BETWEEN 1 AND 12 AND (o_orderkey % 33) BETWEEN 1 AND 31 AS ok FROM orders")
def _(spark, d):
    text = F.concat(F.lit("1995"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lpad((F.col("o_orderkey") % 33).cast("string"), 2, "0"))
    return table(spark, d, "orders").select("o_orderkey", X.plausible_date(text).alias("ok"))


def status_values(codes):
    return ", ".join(f"('{c}', '{t}')" for c, t in codes.items())


@query("status_code_dim", f"""WITH d(code, text) AS (VALUES {status_values(files.FILE_STATUS)}), o(code, text) AS (VALUES {status_values(files.STATUS_OUTCOME)})
SELECT o_orderkey, code, coalesce(d.text, 'Unknown status: ' || code) AS description, CASE WHEN code <> '00' THEN coalesce(o.text, 'Unknown file status: ' || code) END AS outcome, code IN ('00', '10') AS success
FROM (SELECT o_orderkey, lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS code FROM orders) LEFT JOIN d USING (code) LEFT JOIN o USING (code)""")
def _(spark, d):
    """A status for each order: its description, its outcome as an error, and whether it is a success."""
    code = F.lpad((F.col("o_orderkey") % 60).cast("string"), 2, "0")
    return table(spark, d, "orders").select("o_orderkey", code.alias("code"), files.status_description(code).alias("description"), files.status_outcome(code).alias("outcome"), files.status_success(code).alias("success"))
