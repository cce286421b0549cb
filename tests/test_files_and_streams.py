import os

from pyspark.sql import functions as F

from recordloom.sources import files
from recordloom.streaming import posting


def test_fixed_files(spark, tmp_path):
    path = str(tmp_path / "f")
    rows = spark.createDataFrame([(b"AAAAAA",), (b"BB",)], "record binary").coalesce(1)
    files.write_fixed(rows, path, 4)
    assert [bytes(r["record"]) for r in files.read_fixed(spark, path, 4).orderBy("position").collect()] == [b"AAAA", b"BB  "]
    files.write_fixed(rows, path, 4, mode="append")
    assert files.read_fixed(spark, path, 4).count() == 4
    files.write_fixed(rows.limit(1), path, 4)
    assert files.read_fixed(spark, path, 4).count() == 1


def test_ragged_tail(spark, tmp_path):
    path = str(tmp_path / "ragged.dat")
    with open(path, "wb") as f:
        f.write(b"1111222233")
    assert [bytes(r["record"]) for r in files.read_fixed(spark, path, 4).orderBy("position").collect()] == [b"1111", b"2222", b"33  "]
    assert files.read_fixed(spark, path, 4, ragged="drop").count() == 2


def test_rewrite_by_position(spark):
    records = spark.createDataFrame([(k, bytes([65 + k])) for k in range(4)], "position long, record binary")
    changes = spark.createDataFrame([(1, b"x"), (1, b"y"), (9, b"z")], "position long, record binary")
    done, judged = files.rewrite(records, changes)
    assert [bytes(r["record"]) for r in done.orderBy("position").collect()] == [b"A", b"y", b"C", b"D"]
    assert sorted((r["position"], r["file_status"]) for r in judged.collect()) == [(1, "00"), (1, "00"), (9, "23")]


def test_numbering_over_ranges(spark):
    from recordloom.sources.staged import numbered

    df = spark.createDataFrame([(k % 3 if k % 7 else None, k * 37 % 1000) for k in range(1000)], "g int, v int")
    got = numbered(df, ["v"], "rn", ["g"]).collect()
    for g in (0, 1, 2, None):
        own = sorted((r["v"], r["rn"]) for r in got if r["g"] == g)
        assert [n for _, n in own] == list(range(1, len(own) + 1))
    assert sorted(r["rn"] for r in numbered(df, [F.desc("v")]).collect()) == list(range(1, 1001))


def test_variable_files(spark, tmp_path):
    path = str(tmp_path / "v")
    files.write_variable(spark.createDataFrame([(b"x",), (b"longer",), (b"",)], "record binary").coalesce(1), path)
    assert [bytes(r["record"]) for r in files.read_variable(spark, path).orderBy("position").collect()] == [b"x", b"longer", b""]


def test_open_input_status(spark, tmp_path):
    assert files.open_input(spark, str(tmp_path / "none"), 4) == (None, "35")


def test_lines_and_tree(spark, tmp_path):
    path = str(tmp_path / "l")
    files.write_lines(spark.createDataFrame([("a",), ("b",)], "value string"), path)
    assert files.read_lines(spark, path).count() == 2
    os.makedirs(tmp_path / "src" / "sub")
    for name in ("A.CBL", "sub/B.cpy", "README.md"):
        (tmp_path / "src" / name).write_text("X")
    assert {r["type"] for r in files.source_tree(spark, str(tmp_path / "src")).collect()} == {"cobol", "copybook"}


def test_jdbc_both_ways(spark, tmp_path):
    """Spark ships the driver of a database that lives in a folder."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "one", 1.5), (2, None, -2.0)], "k int, name string, v double")
    files.write_jdbc(rows, url, "t", "overwrite", driver="org.apache.derby.jdbc.EmbeddedDriver")
    files.write_jdbc(rows.filter("k = 2"), url, "t", driver="org.apache.derby.jdbc.EmbeddedDriver")
    back = files.jdbc(spark, url, "t", driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted((r["k"], r["name"] or "", r["v"]) for r in back.select(*[F.col(c).alias(c.lower()) for c in back.columns]).collect()) == [(1, "one", 1.5), (2, "", -2.0), (2, "", -2.0)]
    assert back.filter("k = 1").count() == 1


def test_posting_stream_equals_batch(spark, tmp_path):
    schema = "k int, kind string, amt decimal(15,2), dt int, seq int"
    for n, rows in enumerate([[(1, "DP", "5.00", 20240101, 1), (2, "WD", "1.00", 20240102, 2)], [(1, "FE", "0.50", 20240103, 3), (9, "DP", "1.00", 20240104, 4)]]):
        spark.createDataFrame([(k, t, str(a), d, s) for k, t, a, d, s in rows], "k int, kind string, amt string, dt int, seq int").withColumn("amt", F.col("amt").cast("decimal(15,2)")).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    versions = {-1: spark.createDataFrame([(1, 10), (2, 20)], "k int, bal int").select("k", F.col("bal").cast("decimal(15,2)").alias("bal"))}

    def publish(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/v{batch_id}")
        versions[batch_id] = spark.read.parquet(f"{tmp_path}/v{batch_id}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    writer = posting.post_stream(stream, lambda: versions[max(versions)], publish, "k", "bal", "kind", "amt", "dt", "seq")
    writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert {r["k"]: float(r["bal"]) for r in versions[max(versions)].collect()} == {1: 14.5, 2: 19.0}


def test_running_balances_stream(spark, tmp_path):
    spark.createDataFrame([(1, 5.0), (1, -2.0), (2, 1.0)], "k int, amt double").coalesce(1).write.parquet(f"{tmp_path}/b")
    stream = spark.readStream.schema("k int, amt double").parquet(f"{tmp_path}/b")
    out = posting.running_balances(stream, "k", "amt").writeStream.format("memory").queryName("balances").outputMode("update").option("checkpointLocation", f"{tmp_path}/cpb").trigger(availableNow=True).start()
    out.awaitTermination()
    assert {r["k"]: (r["balance"], r["n"]) for r in spark.table("balances").collect()} == {1: (3.0, 2), 2: (1.0, 1)}
