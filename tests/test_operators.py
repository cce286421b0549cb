from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from recordloom.functions import expressions as X
from recordloom.operators import corpus as S
from recordloom.operators import embedded_sql as Q
from recordloom.operators import graph as G
from recordloom.operators import keyed as K


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_rounding_modes(spark):
    x = F.lit(Decimal("2.345"))
    assert [value(spark, X.rounded(x, 2, m)) for m in ("half_even", "half_up", "down")] == [Decimal("2.34"), Decimal("2.35"), Decimal("2.34")]
    assert value(spark, X.truncate(F.lit(Decimal("-2.349")), 2)) == Decimal("-2.34")
    assert value(spark, X.move_decimal(F.lit(Decimal("12345.678")), 5, 2)) == Decimal("345.67")


@pytest.mark.parametrize(("text", "strict", "loose"), [("12", True, True), ("-1.5", True, True), ("1-2", False, True), ("1.2.3", False, True), ("", False, False), ("+", False, True), (".", True, True), ("a", False, False)])
def test_numeric_classes(spark, text, strict, loose):
    assert value(spark, X.is_numeric(F.lit(text))) == strict
    assert value(spark, X.is_numeric_loose(F.lit(text))) == loose


def test_strings(spark):
    assert value(spark, X.replace_leading(F.lit("000100"), "0", "*")) == "***100"
    assert value(spark, X.replace_trailing(F.lit("a.."), ".", "-")) == "a--"
    assert value(spark, X.tally_all(F.lit("aaaa"), "aa")) == 2 and value(spark, X.tally_all(F.lit("a"), "")) == 0
    assert value(spark, X.converting(F.lit("abca"), "aba", "xyz")) == "xycx"
    assert value(spark, X.string_into([(F.lit("JOHN SMITH"), " "), (F.lit("X"), None)])) == "JOHNX"
    u = X.unstring(F.lit("a,,b;c"), [",", ";"], 3, all_=True)
    assert [value(spark, u[f"field_{k}"]) for k in (1, 2, 3)] == ["a", "b", "c"] and value(spark, u["delimiter_1"]) == ",,"
    assert value(spark, X.to_picture(F.lit(Decimal("-1.005")), 6, 2)) == "-0001.00"
    assert value(spark, X.identifier(F.lit("1000-PROCESS-RECORD"), "method")) == "processRecord"
    assert value(spark, X.numval(F.lit("  "))) == 0
    assert value(spark, X.compare_text(F.lit("AB"), F.lit("AB  "))) == 0
    assert value(spark, X.reference(F.lit("ABCDEF"), -2, 3)) == "ABC"


def test_dates(spark):
    assert value(spark, X.integer_of_date(F.lit(19700101))) == 1
    assert value(spark, X.integer_of_date(F.lit(16010101), "iso1601")) == 1
    assert value(spark, X.date_of_integer(X.integer_of_date(F.lit(20240229)))) == 20240229
    assert value(spark, X.plausible_date(F.lit("20240231"))) and not value(spark, X.plausible_date(F.lit("20241301")))


def test_select_into_and_outcomes(spark):
    df = spark.range(3)
    assert Q.select_into(df.filter("id = 1")).value["id"] == 1
    assert Q.select_into(df).is_warning and Q.select_into(df, strict=True).sqlcode == -811 and Q.select_into(df.limit(0)).is_not_found
    assert Q.Outcome(2).map(lambda v: v + 1).value == 3 and Q.Outcome(None, 100).get_or_else(9) == 9
    with pytest.raises(RuntimeError):
        Q.whenever(Q.Outcome(None, -803))


def test_cursor_states(spark):
    cursor = Q.Cursor(spark.range(1))
    assert cursor.fetch().sqlcode == -501 and cursor.close().sqlcode == -501
    cursor.open()
    assert cursor.fetch().is_success and cursor.fetch().is_not_found and cursor.close().is_success


def test_transaction_rolls_back(spark):
    tx = Q.Transaction({"t": spark.range(4)})
    assert tx.delete("t", F.col("id") > 1).rows == 2 and tx["t"].count() == 2
    tx.rollback()
    assert tx["t"].count() == 4 and tx.update("t", {"id": F.lit(0)}, F.col("id") > 9).is_not_found


def test_sql_rewrites():
    assert Q.to_spark("SELECT A INTO :X FROM T WHERE B = :WS-B FETCH FIRST ROW ONLY") == "SELECT A FROM T WHERE B = :ws_b LIMIT 1"


def test_loose_and_strict_calls(spark):
    source = "       CALL 'A' END-CALL DISPLAY 'X'.\n      * CALL 'GHOST'.\n       RECALL C."
    df = spark.createDataFrame([(source,)], "content string")
    assert df.select(S.calls(F.col("content"))).first()[0] == ["A", "DISPLAY", "GHOST", "C"]
    assert df.select(S.calls(F.col("content"), strict=True)).first()[0] == ["A"]


def test_graph(spark):
    edges = spark.createDataFrame([("a", "b", "CALL"), ("b", "c", "CALL"), ("c", "a", "CALL"), ("d", "d", "CALL"), ("e", "f", "CALL"), ("b", "CB", "COPY")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x, "program") for x in "abcde"] + [("UNUSED", "copybook")], "name string, type string")
    assert {tuple(r["cycle"]) for r in G.cycles(edges).collect()} == {("a", "b", "c"), ("d",)}
    assert {r["name"] for r in G.entry_points(nodes, edges).collect()} == {"e", "UNUSED"}
    assert {r["name"]: r["type"] for r in G.missing(nodes, edges).collect()} == {"f": "program", "CB": "copybook"}
    with pytest.raises(ValueError, match="cycle"):
        G.topological_levels(nodes, edges)
    flat = edges.filter("src in ('e', 'b')")
    assert {r["name"]: r["level"] for r in G.topological_levels(nodes, flat).collect()}["c"] == 1
    assert {r["name"]: r["component"] for r in G.weak_components(nodes, edges).collect()}["b"] == "a"


def test_cycles_of_any_length(spark):
    ring = [(f"n{k:02d}", f"n{(k + 1) % 9:02d}") for k in range(9)] + [("n03", "n00"), ("x", "y"), ("y", "n01")]
    edges = spark.createDataFrame(ring, "src string, dst string")
    assert {tuple(r["cycle"]) for r in G.cycles(edges).collect()} == {tuple(f"n{k:02d}" for k in range(9)), ("n00", "n01", "n02", "n03")}
    assert G.cycles(edges, 4).count() == 1


def test_graph_empty(spark):
    edges = spark.createDataFrame([], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a", "program")], "name string, type string")
    assert G.cycles(edges).count() == 0 and G.levels(edges, nodes.select("name")).count() == 1


def test_maintenance_orders_within_a_key(spark):
    store = spark.createDataFrame([(1, "one"), (2, "two")], "k int, v string")
    tx = spark.createDataFrame([(1, 1, "D", ""), (1, 2, "U", "late"), (1, 3, "A", "again"), (3, 1, "U", "x"), (3, 2, "A", "new"), (3, 3, "A", "dup"), (2, 1, "D", "")], "k int, seq int, act string, v string")
    new, status = K.maintain(store, tx, "k", "seq", "act", ["v"])
    assert {r["k"]: r["v"] for r in new.collect()} == {1: "again", 3: "new"}
    assert {(r["k"], r["seq"]): r["file_status"] for r in status.collect()} == {(1, 1): "00", (1, 2): "23", (1, 3): "00", (3, 1): "23", (3, 2): "00", (3, 3): "22", (2, 1): "00"}


def test_start_on_nothing(spark):
    rows, status = K.start(spark.range(3), "id", ">", 10)
    assert status == "23" and rows.count() == 0


def test_insert_and_update_with_repeated_keys(spark):
    store = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new, judged = K.insert(store, spark.createDataFrame([(3, "x", 2), (3, "w", 1), (1, "q", 3)], "k int, v string, seq int"), ["k"], "seq")
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "b"), (3, "w")]
    assert sorted((r["seq"], r["file_status"]) for r in judged.collect()) == [(1, "00"), (2, "22"), (3, "22")]
    changed, status = K.update(store, spark.createDataFrame([(1, "y", 2), (1, "z", 1), (9, "n", 3)], "k int, v string, seq int"), ["k"], "seq")
    assert sorted(map(tuple, changed.collect())) == [(1, "y"), (2, "b")]
    assert sorted((r["seq"], r["file_status"]) for r in status.collect()) == [(1, "00"), (2, "00"), (3, "23")]


def test_call_by_reference_content_and_exception(spark):
    from recordloom.operators.calls import call

    df = spark.createDataFrame([("A", 1, 2), ("B", 3, 4), ("GONE", 5, 6), (None, 7, 8)], "name string, x int, y int")
    programs = {"a": lambda x, y: {0: x + 10, 1: y + 10, "returning": x + y}, "B": lambda x, y: {1: y * 2}}
    out = call(df, programs, F.col("name"), ["x", "y"], content=[0], returning="rc").orderBy("x").collect()
    assert [(r["x"], r["y"], r["rc"], r["exception"]) for r in out] == [(1, 12, 3, False), (3, 8, None, False), (5, 6, None, True), (7, 8, None, True)]


def test_where_current_of(spark):
    df = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    tx, cursor = Q.Transaction({"t": df}), Q.Cursor(df.orderBy("k"))
    assert tx.update_current("t", cursor, ["k"], {"v": F.lit(0)}).sqlcode == -508
    cursor.open()
    cursor.fetch()
    cursor.fetch()
    assert tx.update_current("t", cursor, ["k"], {"v": F.lit(0)}).value == 1 and sorted(map(tuple, tx["t"].collect())) == [(1, 5), (2, 0)]
    assert tx.delete_current("t", cursor, ["k"]).is_success and tx["t"].count() == 1


def test_commit_groups_restart(spark, tmp_path):
    from recordloom.operators import batch as B

    groups = B.commit_groups_global(spark.range(95).withColumnRenamed("id", "k"), "k", 10)
    assert B.publish_groups(groups.filter("commit_group < 3"), str(tmp_path / "c")).count() == 30
    out = B.publish_groups(groups, str(tmp_path / "c"))
    assert out.count() == 95 and out.select("k").distinct().count() == 95
