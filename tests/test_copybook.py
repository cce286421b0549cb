from decimal import Decimal

from pyspark.sql import functions as F

from recordloom.plans import copybook as K


def test_pictures():
    x = K.parse_picture("S9(11)V99")
    assert (x.kind, x.signed, x.integers, x.decimals) == ("numeric", True, 11, 2)
    assert K.parse_picture("X(25)").kind == "alphanumeric" and K.parse_picture("X(25)").size == 25
    assert K.parse_picture("A(3)").kind == "alphabetic"
    assert K.parse_picture("$ZZ,ZZ9.99").kind == "edited" and K.parse_picture("$ZZ,ZZ9.99").size == 10
    assert K.parse_picture("9(3)PP").scaling == 2 and K.parse_picture("VPP9(3)").decimals == 3


def test_sizes():
    sizes = {"S9(4) COMP": 2, "S9(9) COMP": 4, "9(10) BINARY": 8, "S9(7)V99 COMP-3": 5, "S9(4) COMP-5": 2}
    for text, size in sizes.items():
        assert K.parse(f"01 A. 05 B PIC {text}.")[0].size == size
    assert K.parse("01 A. 05 B COMP-1. 05 C COMP-2. 05 D INDEX.")[0].size == 16


def test_tree_and_conditions():
    root = K.parse("01 R. 05 G. 10 A PIC X(2). 88 OK VALUES 'AA' 'BB' THRU 'DD'. 10 B PIC 9. 05 T OCCURS 5 TIMES PIC 9(3). 05 FILLER PIC X. 05 FILLER PIC X.")[0]
    assert [c.name for c in root.children] == ["G", "T", "FILLER-1", "FILLER-2"] and root.size == 3 + 15 + 2
    assert root.children[0].children[0].conditions == {"OK": ["AA", ("BB", "DD")]}
    assert [r.level for r in K.parse("77 A PIC 9. 77 B PIC 9. 01 C. 05 D PIC 9.")] == [77, 77, 1]


def test_fixed_format_source():
    source = "000100 01  R.\n000200* NOTE\n000300     05  A PIC X(3).\n           05  B PIC 9(2).                                     IGNORED\n"
    assert K.parse(source)[0].size == 5


def test_round_trip(spark):
    root = K.parse("01 R. 05 K PIC 9(5). 05 N PIC X(6). 05 G. 10 P PIC S9(5)V99 COMP-3. 10 C PIC S9(4) COMP. 05 T OCCURS 2 TIMES. 10 V PIC S9(3). 05 L PIC S9(3) SIGN LEADING SEPARATE. 05 J PIC X(4) JUST RIGHT.")[0]
    rows = spark.createDataFrame([(7, "ab", (Decimal("-1.25"), -3), [(-1,), (2,)], -45, "z"), (99999, "toolong", (Decimal("99999.99"), 9999), [(0,), (999,)], 12, "longer")], "k int, n string, g struct<p: decimal(7,2), c: smallint>, t array<struct<v: smallint>>, l smallint, j string")
    for ebcdic in (False, True):
        back = K.decode(K.encode(rows, root, ebcdic=ebcdic), root, ebcdic=ebcdic).orderBy("k").collect()
        assert back[0]["n"] == "ab" and back[0]["g"]["p"] == Decimal("-1.25") and back[0]["g"]["c"] == -3 and [x["v"] for x in back[0]["t"]] == [-1, 2] and back[0]["l"] == -45 and back[0]["j"] == "z"
        assert back[1]["n"] == "toolon" and back[1]["g"]["p"] == Decimal("99999.99") and back[1]["j"] == "nger"


def test_unused_fields_cost_nothing(spark):
    root = K.parse("01 R. 05 A PIC 9(3). 05 B PIC S9(5) COMP-3.")[0]
    rows = spark.createDataFrame([(1, 2)], "a smallint, b int")
    plan = K.decode(K.encode(rows, root), root).select("a")._jdf.queryExecution().optimizedPlan().toString()
    assert "endswith" not in plan.lower()


def test_condition_columns(spark):
    root = K.parse("01 R. 05 S PIC X. 88 GOOD VALUE 'A' 'B'. 05 N PIC 9(3). 88 MID VALUE 10 THRU 20.")[0]
    df = spark.createDataFrame([("A", 15), ("C", 21)], "s string, n int")
    names = K.condition_columns(root)
    assert [tuple(r) for r in df.select(names["GOOD"], names["MID"]).collect()] == [(True, True), (False, False)]
    assert K.flatten(spark, [root]).filter(F.col("path") == "R.N").first()["offset"] == 1


def test_copybooks_of_one_row_group_are_parsed_by_many_tasks(spark, tmp_path, monkeypatch):
    """A file of one row group, in which every other row has the same text: texts are dealt over tasks, each parsed once,
    and a row has the items of its own."""
    spark.range(2000).selectExpr("id", "case when id % 50 = 0 then null when id % 50 = 1 then 'no copybook' when id % 2 = 0 then '01 R. 05 A PIC 9(3).' else concat('01 R. 05 A PIC X(', id, '). 05 B PIC 9(2) COMP.') end as text").coalesce(1).write.parquet(str(tmp_path / "f"))
    sources, written = spark.read.parquet(str(tmp_path / "f")), []
    monkeypatch.setattr(K, "settled", lambda df, f=K.settled: written.append(f(df)) or written[-1])
    found = {}
    for r in K.items_of(sources, "id", "text").collect():
        found.setdefault(r["id"], []).append((r["position"], r["path"], r["offset"], r["length"]))
    want = {k: [(0, "R", 0, 3), (1, "R.A", 0, 3)] if k % 2 == 0 else [(0, "R", 0, k + 2), (1, "R.A", 0, k), (2, "R.B", k, 2)] for k in range(2000) if k % 50 > 1}
    assert {k: sorted(v) for k, v in found.items()} == want
    assert written[0].count() == 962 and len(written[0].inputFiles()) > 4
