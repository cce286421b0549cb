"""Record files written and read back, commit groups, subprograms and cursors over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions import codecs as C
from recordloom.functions import expressions as X
from recordloom.operators import batch as B
from recordloom.operators import embedded_sql as Q
from recordloom.operators import keyed as K
from recordloom.operators.calls import call
from recordloom.plans import copybook
from recordloom.plans.registry import Registry, table
from recordloom.sources import files
from recordloom.sources.sorted_files import SortedStore
from recordloom.sources.staged import new_path
from recordloom.sources.versions import VersionedStore, committed_groups

query = Registry()
MONEY = "decimal(15,2)"

CUSTOMER_COPYBOOK = """
       01  CUSTOMER-RECORD.
           05  CUST-KEY        PIC 9(9) COMP.
           05  CUST-NAME       PIC X(20).
           05  CUST-BALANCE    PIC S9(7)V99 COMP-3.
           05  CUST-SEGMENT    PIC X(10).
"""
CUSTOMER_SQL = "SELECT CAST(c_custkey AS INT) AS cust_key, c_name AS cust_name, CAST(CAST(c_acctbal AS DECIMAL(9,2)) AS DOUBLE) AS cust_balance, c_mktsegment AS cust_segment FROM customer"


def layout():
    return copybook.parse(CUSTOMER_COPYBOOK)[0]


def customer_records(spark, d):
    """Customers as bytes of CUSTOMER_COPYBOOK."""
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("int").alias("cust_key"), F.col("c_name").alias("cust_name"), F.col("c_acctbal").cast("decimal(9,2)").alias("cust_balance"), F.col("c_mktsegment").alias("cust_segment"))
    return copybook.encode(rows, layout())


def shown(records):
    return copybook.decode(records.drop("position"), layout()).withColumn("cust_balance", F.col("cust_balance").cast("double"))


@query("fixed_scan", CUSTOMER_SQL)
def _(spark, d):
    path = new_path(spark, "fixed")
    files.write_fixed(customer_records(spark, d), path, layout().size)
    return shown(files.read_fixed(spark, path, layout().size))


@query("fixed_extend", "SELECT count(*) * 2 AS n, CAST(2 * sum(CAST(c_acctbal AS DECIMAL(9,2))) AS DOUBLE) AS balance FROM customer")
def _(spark, d):
    """OPEN OUTPUT, then EXTEND."""
    path = new_path(spark, "extend")
    for mode in ("overwrite", "append"):
        files.write_fixed(customer_records(spark, d), path, layout().size, mode)
    out = copybook.decode(files.read_fixed(spark, path, layout().size).drop("position"), layout())
    return out.agg(F.count(F.lit(1)).alias("n"), F.sum("cust_balance").cast("double").alias("balance"))


@query("line_sequential", "SELECT rpad(c_name, 25, ' ') || c_mktsegment AS value FROM customer")
def _(spark, d):
    path = new_path(spark, "lines")
    files.write_lines(table(spark, d, "customer").select(F.concat(C.fixed_string(F.col("c_name"), 25), "c_mktsegment").alias("value")), path)
    return files.read_lines(spark, path)


@query("rdw_scan", "SELECT c_custkey, c_name, c_comment_size FROM (SELECT c_custkey, c_name, CAST(c_custkey % 30 AS BIGINT) AS c_comment_size FROM customer)")
def _(spark, d):
    """Records of several lengths: a packed key, a name of twenty bytes, and a run of stars."""
    path = new_path(spark, "rdw")
    record = F.concat(C.encode_packed(F.col("c_custkey"), 9), F.encode(C.fixed_string(F.col("c_name"), 20), "ISO-8859-1"), F.encode(F.repeat(F.lit("*"), (F.col("c_custkey") % 30).cast("int")), "ISO-8859-1"))
    files.write_variable(table(spark, d, "customer").select(record.alias("record")), path)
    data = files.read_variable(spark, path)
    part = lambda a, n: F.substr("record", F.lit(a), F.lit(n))
    return data.select(C.decode_packed(part(1, 5), 9).cast("long").alias("c_custkey"), C.decode_text(part(6, 20)).alias("c_name"), (F.octet_length("record") - 25).cast("long").alias("c_comment_size"))


@query("rewrite_record", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'CLOSED' ELSE c_mktsegment END AS segment FROM customer")
def _(spark, d):
    """READ, then REWRITE in place of every fourth record."""
    path = new_path(spark, "rewrite")
    files.write_fixed(customer_records(spark, d), path, layout().size)
    records = files.read_fixed(spark, path, layout().size)
    key = C.decode_binary(F.substr("record", F.lit(1), F.lit(4)), 4)
    closed = F.concat(F.substr("record", F.lit(1), F.lit(layout().size - 10)), F.encode(F.rpad(F.lit("CLOSED"), 10, " "), "ISO-8859-1"))
    done, _ = files.rewrite(records, records.filter(key % 4 == 0).select("position", closed.alias("record")))
    return shown(done).select(F.col("cust_key").cast("long").alias("c_custkey"), F.col("cust_segment").alias("segment"))


@query("rewrite_status", "SELECT CASE WHEN c_custkey % 4 = 0 THEN '23' ELSE '00' END AS file_status, count(*) AS n FROM customer GROUP BY 1")
def _(spark, d):
    records = customer_records(spark, d).withColumn("position", C.decode_binary(F.substr("record", F.lit(1), F.lit(4)), 4))
    changes = records.withColumn("position", F.when(F.col("position") % 4 == 0, -1 - F.col("position")).otherwise(F.col("position")))
    return files.rewrite(records, changes)[1].groupBy("file_status").agg(F.count(F.lit(1)).alias("n"))


@query("indexed_persist", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey) AS BIGINT) AS rank FROM orders GROUP BY o_custkey")
def _(spark, d):
    """An indexed file closed and opened again: the last record of each key, by its place in the store."""
    path = new_path(spark, "indexed")
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderkey").alias("position"))
    SortedStore.write(K.load_last(rows, ["o_custkey"], "position").select("o_custkey", F.col("o_orderkey")), path, ["o_custkey"])
    return SortedStore(spark, path).ranked()


@query("relative_record", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) AS BIGINT) AS record_number, s_name FROM supplier")
def _(spark, d):
    """A relative file of several parts: numbers go on from part to part."""
    path = new_path(spark, "relative")
    ordered = table(spark, d, "supplier").repartitionByRange(6, "s_suppkey").sortWithinPartitions("s_suppkey").select(F.encode(C.fixed_string(F.col("s_name"), 25), "ISO-8859-1").alias("record"))
    files.write_fixed(ordered, path, 25)
    return K.relative_record(files.read_fixed(spark, path, 25), "position").select("record_number", C.decode_text(F.col("record")).alias("s_name"))


@query("relative_slots", """WITH last AS (SELECT c_custkey * 3 AS record_number, c_name, c_custkey % 4 = 0 AS gone FROM customer)
SELECT o.o_orderkey, CASE WHEN l.c_name IS NULL OR l.gone THEN '23' ELSE '00' END AS file_status, CASE WHEN NOT l.gone THEN l.c_name END AS c_name
FROM orders o LEFT JOIN last l ON l.record_number = o.o_custkey + o.o_orderkey % 5""")
def _(spark, d):
    """A relative file in which two of three slots were never written and every fourth record is deleted, read by number."""
    file = K.RelativeFile(spark, new_path(spark, "slots"), 25)
    file.load(table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("record_number"), F.encode(F.col("c_name"), "ISO-8859-1").alias("record")))
    file.delete(table(spark, d, "customer").filter("c_custkey % 4 = 0").select((F.col("c_custkey") * 3).alias("record_number")))
    requests = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") + F.col("o_orderkey") % 5).alias("record_number"))
    return file.read_at(requests).select("o_orderkey", "file_status", C.decode_text(F.col("record")).alias("c_name"))


@query("fixed_ragged", "SELECT c_custkey, CASE WHEN c_custkey = (SELECT max(c_custkey) FROM customer) THEN rpad(left(c_name, 12), 20, ' ') ELSE rpad(c_name, 20, ' ') END AS c_name FROM customer")
def _(spark, d):
    """A file whose last record is short: the rest of it is blanks."""
    path = new_path(spark, "short")
    rows = table(spark, d, "customer").repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey")
    text = F.concat(F.lpad(F.col("c_custkey").cast("string"), 10, "0"), C.fixed_string(F.col("c_name"), 20))
    last = table(spark, d, "customer").agg(F.max("c_custkey").alias("last"))
    short = rows.join(F.broadcast(last)).select(F.encode(F.when(F.col("c_custkey") == F.col("last"), F.left(text, F.lit(22))).otherwise(text), "ISO-8859-1").alias("record"))  # one row
    # a writer of records would pad it: a length of two divides both kinds of records
    halves = short.select(F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("record"), F.lit(2)), lambda k: F.substr("record", k, F.lit(2)))).alias("record"))
    files.write_fixed(halves, path, 2)
    record = F.decode("record", "ISO-8859-1")
    return files.read_fixed(spark, path, 30).select(F.substr(record, F.lit(1), F.lit(10)).cast("long").alias("c_custkey"), F.substr(record, F.lit(11)).alias("c_name"))


@query("rdw_blocked", "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS position, o_orderkey, CAST(o_orderkey % 90 AS BIGINT) AS stars FROM orders")
def _(spark, d):
    """BLOCK CONTAINS 4096 CHARACTERS: records of several lengths in blocks, over several files, numbered in order."""
    path = new_path(spark, "blocked")
    rows = table(spark, d, "orders").repartitionByRange(6, "o_orderkey").sortWithinPartitions("o_orderkey")
    files.write_variable(rows.select(F.encode(F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.repeat(F.lit("*"), (F.col("o_orderkey") % 90).cast("int"))), "ISO-8859-1").alias("record")), path, block=4096)
    back = files.read_variable(spark, path, blocked=True)
    return back.select("position", F.decode(F.substr("record", F.lit(1), F.lit(12)), "ISO-8859-1").cast("long").alias("o_orderkey"), (F.octet_length("record") - 12).cast("long").alias("stars"))


@query("rdw_status", "SELECT f AS file, n AS records, CASE WHEN f = 'whole' THEN '00' ELSE '04' END AS file_status FROM (SELECT count(*) AS n FROM supplier), (VALUES ('torn'), ('whole')) t(f)")
def _(spark, d):
    """A length-prefixed file, and one of the same records with a descriptor at its end that promises more than is there."""
    rows = table(spark, d, "supplier").select("s_suppkey", F.encode("s_name", "ISO-8859-1").alias("record")).coalesce(1)
    framed = F.concat(F.unhex(F.lpad(F.hex((F.octet_length("record") + 4).cast("long")), 4, "0")), F.unhex(F.lit("0000")), "record")
    torn = rows.select(framed.alias("record")).unionByName(spark.range(1).select(F.unhex(F.lit("00640000")).alias("record"))).coalesce(1)
    found = []
    for name, frame in (("whole", rows.select(framed.alias("record"))), ("torn", torn)):
        path = new_path(spark, name)
        single = frame.select(F.explode(F.transform(F.sequence(F.lit(1), F.octet_length("record")), lambda k: F.substr("record", k, F.lit(1)))).alias("record"))
        files.write_fixed(single, path, 1)
        found.append(files.variable_status(spark, path).select(F.lit(name).alias("file"), "records", "file_status"))
    return found[0].unionByName(found[1])


@query("open_input_status", """SELECT n_name, CASE WHEN mode IN ('INPUT', 'I-O') AND n_nationkey % 2 = 1 THEN '35' ELSE '00' END AS opened,
  CASE WHEN mode IN ('OUTPUT', 'EXTEND') OR (mode IN ('INPUT', 'I-O') AND n_nationkey % 2 = 1) THEN '47' ELSE '00' END AS read,
  CASE WHEN mode IN ('INPUT', 'I-O') AND n_nationkey % 2 = 0 THEN (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) END AS records
FROM (SELECT *, ['INPUT', 'OUTPUT', 'I-O', 'EXTEND'][n_nationkey % 4 + 1] AS mode FROM nation)""")
def _(spark, d):
    """A file of customers for every other nation, each nation's file opened in one of the four modes and read."""
    folder = new_path(spark, "nations")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # a file for each
    found = []
    for n in nations:
        key, path = n["n_nationkey"], f"{folder}/{n['n_nationkey']}"
        if key % 2 == 0:
            files.write_fixed(table(spark, d, "customer").filter(F.col("c_nationkey") == key).select(F.encode("c_name", "ISO-8859-1").alias("record")), path, 20)
        file = files.RecordFile(spark, path, 20)
        opened = file.open(("INPUT", "OUTPUT", "I-O", "EXTEND")[key % 4])
        rows = file.read()
        found.append((n["n_name"], opened, file.status, None if rows is None else rows.count()))
    return spark.createDataFrame(found, "n_name string, opened string, read string, records bigint")


@query("indexed_point_read", "SELECT n_nationkey, o_orderkey, o_custkey, CASE WHEN o_orderkey IS NULL THEN '23' ELSE '00' END AS file_status FROM nation LEFT JOIN orders ON o_orderkey = n_nationkey * 37")
def _(spark, d):
    """READ by key from a store of many files: only those that can hold a key are opened."""
    store = SortedStore.write(table(spark, d, "orders").select("o_orderkey", "o_custkey"), new_path(spark, "index"), ["o_orderkey"], files=32)
    requests = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") * 37).cast("long").alias("o_orderkey"))
    found = store.read_keys(requests)
    return found.select("n_nationkey", F.when(F.col("file_status") == "00", F.col("o_orderkey")).alias("o_orderkey"), "o_custkey", "file_status")


@query("indexed_browse", """(SELECT 'next' AS way, o_totalprice, o_orderkey FROM orders WHERE o_totalprice > 150000 ORDER BY o_totalprice, o_orderkey LIMIT 40)
UNION ALL (SELECT 'previous', o_totalprice, o_orderkey FROM orders WHERE o_totalprice < 150000 ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 40)""")
def _(spark, d):
    """READ NEXT and READ PREVIOUS from a value between the keys of an alternate index."""
    store = SortedStore.write(table(spark, d, "orders").select("o_totalprice", "o_orderkey"), new_path(spark, "browse"), ["o_totalprice", "o_orderkey"], files=32)
    after = store.read_next(40, 150_000.0).select(F.lit("next").alias("way"), "o_totalprice", "o_orderkey")
    return after.unionByName(store.read_previous(40, 150_000.0).select(F.lit("previous").alias("way"), "o_totalprice", "o_orderkey"))


@query("fetch_relative_many", """WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT a.o_orderkey AS from_key, b.o_orderkey AS to_key FROM r a LEFT JOIN r b ON b.n = a.n + a.o_custkey % 7 - 3""")
def _(spark, d):
    """FETCH RELATIVE -3 to +3 from every row of a cursor: the rows are sorted once, into a store with a directory of ranks."""
    store = SortedStore.write(table(spark, d, "orders").select("o_orderkey", "o_custkey"), new_path(spark, "ranks"), ["o_orderkey"])
    moves = store.ranked().select(F.col("o_orderkey").alias("from_key"), F.nullif(F.col("rank") + F.col("o_custkey") % 7 - 3, F.lit(0).cast("long")).alias("position"))
    inside = moves.withColumn("position", F.when(F.col("position") > 0, F.col("position")))
    return store.fetch_many(inside, "position").select("from_key", F.col("o_orderkey").alias("to_key"))


@query("restart_after_commit", "SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 100 AS BIGINT) AS commit_group, c_custkey, CAST(CAST(c_acctbal AS DECIMAL(15,2)) AS DOUBLE) AS bal FROM customer")
def _(spark, d):
    """Batch update with a commit every 100 rows, five commits a job, in a versioned store: the first run ends after its
    first commits, the second goes on from the position in the manifest."""
    path = new_path(spark, "restart")
    source = SortedStore.write(table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("bal")), f"{path}/source", ["c_custkey"])
    for _ in committed_groups(VersionedStore(spark, path), "master", source, 100, 5):
        break  # the first run is lost here
    for _ in committed_groups(VersionedStore(spark, path), "master", source, 100, 5):
        pass
    return VersionedStore(spark, path).read("master").select("commit_group", "c_custkey", F.col("bal").cast("double").alias("bal"))


@query("stored_transaction", """WITH m AS (SELECT c_custkey, c_nationkey, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer)
SELECT 'master' AS t, c_custkey AS k, CAST(CASE WHEN c_nationkey < 5 THEN bal + 100 ELSE bal END AS DOUBLE) AS bal FROM m WHERE NOT (c_nationkey = 7 AND bal < 0)
UNION ALL SELECT 'log', s_suppkey, CAST(CAST(s_acctbal AS DECIMAL(15,2)) AS DOUBLE) FROM supplier""")
def _(spark, d):
    """Two tables changed in one transaction that ends at a savepoint and is resumed by another session; a rolled-back
    change leaves no trace."""
    path = new_path(spark, "store")
    store = VersionedStore(spark, path)
    tx = store.begin()
    tx.create("master", table(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").cast(MONEY).alias("bal")).repartitionByRange(6, "c_nationkey"))
    tx.create("log", table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast(MONEY).alias("bal")).limit(0))
    tx.commit()
    tx = store.begin()
    tx.update("master", {"bal": F.col("bal") + 100}, F.col("c_nationkey") < 5)
    kept = tx.savepoint("kept")
    tx.delete("master", F.col("c_nationkey") > 10)
    tx.rollback_to(kept)
    later = VersionedStore(spark, path).resume(kept)
    later.delete("master", (F.col("c_nationkey") == 7) & (F.col("bal") < 0))
    later.insert("log", table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").cast(MONEY).alias("bal")))
    later.commit()
    out = VersionedStore(spark, path)
    master = out.read("master").select(F.lit("master").alias("t"), F.col("c_custkey").alias("k"), F.col("bal").cast("double").alias("bal"))
    return master.unionByName(out.read("log").select(F.lit("log").alias("t"), F.col("s_suppkey").alias("k"), F.col("bal").cast("double").alias("bal")))


@query("keyed_insert_repeats", "SELECT o_orderkey AS seq, CASE WHEN o_custkey % 5 = 0 OR row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 THEN '22' ELSE '00' END AS file_status FROM orders")
def _(spark, d):
    """WRITE of all orders by customer into a file that has every fifth customer: one record a key is stored."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"))
    there = rows.filter("k % 5 = 0").groupBy("k").agg(F.max("seq").alias("seq"))
    new, judged = K.insert(there, rows, ["k"], "seq")
    return judged.join(new.select("k").distinct(), "k", "left_semi").select("seq", "file_status")


@query("keyed_update_repeats", "SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY o_custkey")
def _(spark, d):
    """REWRITE once for each order: a customer has one record, with the last order's status."""
    changes = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("s"))
    return K.update(changes.select("k", F.lit("?").alias("s")).distinct(), changes, ["k"], "seq")[0]


@query("pic_comp3_scale9", "SELECT l_orderkey, l_linenumber, lpad(CAST(l_orderkey * 1000 + l_linenumber AS VARCHAR), 17, '0') || CASE WHEN l_linenumber % 2 = 0 THEN 'D' ELSE 'C' END AS bytes, CAST((l_orderkey * 1000 + l_linenumber) * CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END AS BIGINT) AS back FROM lineitem")
def _(spark, d):
    """Nine decimals: none is lost on the way."""
    number = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    signed = F.when(F.col("l_linenumber") % 2 == 0, -number).otherwise(number)
    value = (signed.cast("decimal(17,0)") * F.lit("0.000000001").cast("decimal(10,9)")).cast("decimal(17,9)")
    data = C.encode_packed(value, 17, 9)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.hex(data).alias("bytes"), (C.decode_packed(data, 17, 9).cast("decimal(27,9)") * 1_000_000_000).cast("long").alias("back"))


@query("commit_groups_published", "SELECT CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS BIGINT) AS commit_group, c_custkey FROM customer")
def _(spark, d):
    """Batch update with a commit every 500 rows, stopped after the first commits and started again."""
    path = new_path(spark, "commits")
    groups = B.commit_groups_global(table(spark, d, "customer").select("c_custkey"), "c_custkey", 500)
    B.publish_groups(groups.filter("commit_group < 2"), path)
    return B.publish_groups(groups, path).select(F.col("commit_group").cast("long").alias("commit_group"), "c_custkey")


@query("run_summary", "SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus <> 'F') AS failed FROM orders")
def _(spark, d):
    return B.run_summary(table(spark, d, "orders"), F.col("o_orderstatus") == "F")


@query("call_using", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(bal + 10 AS DOUBLE) ELSE CAST(bal AS DOUBLE) END AS bal, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_nationkey + 100 AS BIGINT) WHEN c_custkey % 3 = 1 THEN CAST(c_nationkey * 2 AS BIGINT) END AS rc, c_custkey % 3 = 2 AS missing FROM (SELECT *, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer)")
def _(spark, d):
    """CALL identifier USING a balance by reference and a nation by content, RETURNING a code, ON EXCEPTION for a third."""
    programs = {
        "CREDIT": lambda bal, nation: {0: (bal + 10).cast(MONEY), 1: nation + 1, "returning": (nation + 100).cast("long")},
        "DOUBLE": lambda bal, nation: {"returning": (nation * 2).cast("long")},
    }
    name = F.element_at(F.array(F.lit("credit"), F.lit("DOUBLE"), F.lit("GHOST")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").cast(MONEY).alias("bal"), "c_nationkey")
    return call(rows, programs, name, ["bal", "c_nationkey"], content=[1], returning="rc", exception="missing").withColumn("bal", F.col("bal").cast("double"))


@query("unstring_pointer", "SELECT p_partkey, coalesce(string_split(substr(p_name, 3), ' ')[1], '') AS first, CAST(3 + length(string_split(substr(p_name, 3), ' ')[1]) + CASE WHEN len(string_split(substr(p_name, 3), ' ')) > 1 THEN 1 ELSE 0 END AS BIGINT) AS pointer, len(string_split(substr(p_name, 3), ' ')) > 1 AS overflow FROM part")
def _(spark, d):
    u = X.unstring(F.col("p_name"), [" "], 1, pointer=F.lit(3))
    return table(spark, d, "part").select("p_partkey", u["field_1"].alias("first"), u["pointer"].alias("pointer"), u["overflow"].alias("overflow"))


@query("embedded_join", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 100 GROUP BY n_name")
def _(spark, d):
    sql = "SELECT N.N_NAME AS n_name, COUNT(*) AS n INTO :WS-NAME, :WS-N FROM CUST C INNER JOIN NAT N ON C.C_NATIONKEY = N.N_NATIONKEY WHERE C.C_ACCTBAL > :WS-LEAST GROUP BY N.N_NAME"
    return Q.query(spark, sql, {"WS-LEAST": 100}, CUST=table(spark, d, "customer"), NAT=table(spark, d, "nation"))


@query("embedded_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
def _(spark, d):
    sql = "SELECT C_NATIONKEY AS k FROM CUST WHERE C_ACCTBAL < :Z UNION SELECT S_NATIONKEY FROM SUPP EXCEPT SELECT N_NATIONKEY FROM NAT WHERE N_REGIONKEY = :R FOR READ ONLY"
    return Q.query(spark, sql, {"Z": 0, "R": 1}, CUST=table(spark, d, "customer"), SUPP=table(spark, d, "supplier"), NAT=table(spark, d, "nation"))


@query("update_current_of", "SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = 3) THEN 0.0 ELSE s_acctbal END AS bal FROM supplier")
def _(spark, d):
    """FETCH of the first row of a cursor, then UPDATE … WHERE CURRENT OF it."""
    suppliers = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("bal"))
    cursor, tx = Q.Cursor(suppliers.filter("s_nationkey = 3").orderBy("s_suppkey")), Q.Transaction({"supp": suppliers})
    cursor.open()
    cursor.fetch()
    tx.update_current("supp", cursor, ["s_suppkey"], {"bal": F.lit(0.0)})
    tx.commit()
    return tx.published["supp"].select("s_suppkey", "bal")


@query("set_condition", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS status FROM orders")
def _(spark, d):
    """SET a condition name TO TRUE moves its first value."""
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, X.set_condition(["F", "P"])).otherwise(F.col("o_orderstatus")).alias("status"))
