"""Keyed files, match-merge, control breaks, validation, sorting and embedded SQL over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.functions.expressions import to_picture
from recordloom.operators import batch as B
from recordloom.operators import embedded_sql as Q
from recordloom.operators import keyed as K
from recordloom.plans.registry import Registry, table

query = Registry()
MONEY = "decimal(15,2)"

#: Keyed store: all customers, those with multiples of 7 under another key, so that both sides of every match have
#: rows without a partner.
STORE_SQL = "store AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1000000000 ELSE c_custkey END AS c_custkey, c_name, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer)"


def store(spark, d):
    key = F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") + 1_000_000_000).otherwise(F.col("c_custkey"))
    return table(spark, d, "customer").select(key.alias("c_custkey"), "c_name", F.col("c_acctbal").cast(MONEY).alias("bal"))


@query("keyed_read_status", f"WITH {STORE_SQL} SELECT o_orderkey, o_custkey AS c_custkey, c_name, CASE WHEN c_name IS NULL THEN '23' ELSE '00' END AS file_status FROM orders LEFT JOIN store ON o_custkey = c_custkey")
def _(spark, d):
    requests = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return K.read_keys(requests, store(spark, d).select("c_custkey", "c_name"), ["c_custkey"])


@query("keyed_insert", f"WITH {STORE_SQL} SELECT c.c_custkey, CASE WHEN s.c_custkey IS NULL THEN '00' ELSE '22' END AS file_status FROM customer c LEFT JOIN store s ON c.c_custkey = s.c_custkey")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast(MONEY).alias("bal"))
    return K.insert(store(spark, d), rows, ["c_custkey"])[1].select("c_custkey", "file_status")


@query("keyed_insert_store", f"WITH {STORE_SQL} SELECT count(*) AS n, CAST(sum(bal) AS DOUBLE) AS bal FROM (SELECT bal FROM store UNION ALL SELECT CAST(c_acctbal AS DECIMAL(15,2)) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM store))")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast(MONEY).alias("bal"))
    new, _ = K.insert(store(spark, d), rows, ["c_custkey"])
    return new.agg(F.count(F.lit(1)).alias("n"), F.sum("bal").cast("double").alias("bal"))


@query("keyed_update", f"WITH {STORE_SQL} SELECT c_custkey, c_name, CAST(CASE WHEN c_custkey < 1000000000 THEN 1.5 ELSE bal END AS DOUBLE) AS bal FROM store")
def _(spark, d):
    changes = table(spark, d, "customer").select("c_custkey", F.lit("1.5").cast(MONEY).alias("bal"))
    new, _ = K.update(store(spark, d), changes, ["c_custkey"])
    return new.withColumn("bal", F.col("bal").cast("double"))


@query("keyed_update_status", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '23' ELSE '00' END AS file_status FROM customer")
def _(spark, d):
    changes = table(spark, d, "customer").select("c_custkey", F.lit("1.5").cast(MONEY).alias("bal"))
    return K.update(store(spark, d), changes, ["c_custkey"])[1].select("c_custkey", "file_status")


@query("keyed_delete", f"WITH {STORE_SQL} SELECT c_custkey, c_name FROM store WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    gone = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return K.delete(store(spark, d), gone, ["c_custkey"])[0].select("c_custkey", "c_name")


def moves(spark, d):
    """Of every customer: an add of multiples of 7, else an add and an update of multiples of 3, else a delete and an
    update of even keys, else nothing."""
    k = F.col("c_custkey")
    step = lambda seq, act, name: F.struct(F.lit(seq).alias("seq"), F.lit(act).alias("act"), F.lit(name).alias("c_name"))
    steps = F.when(k % 7 == 0, F.array(step(1, "A", "ADDED"))).when(k % 3 == 0, F.array(step(1, "A", "TWICE"), step(2, "U", "CHANGED"))).when(k % 2 == 0, F.array(step(1, "D", ""), step(2, "U", "LATE")))
    return table(spark, d, "customer").select("c_custkey", F.inline(steps))


@query("keyed_maintenance", """
SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'ADDED' WHEN c_custkey % 3 = 0 THEN 'CHANGED' ELSE c_name END AS c_name FROM customer WHERE NOT (c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 = 0)
UNION ALL SELECT c_custkey + 1000000000, c_name FROM customer WHERE c_custkey % 7 = 0""")
def _(spark, d):
    return K.maintain(store(spark, d).select("c_custkey", "c_name"), moves(spark, d), "c_custkey", "seq", "act", ["c_name"])[0]


@query("keyed_maintenance_status", """
SELECT '22' AS file_status, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 7 <> 0 UNION ALL SELECT '00', count(*) FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 3 = 0 OR c_custkey % 2 = 0
UNION ALL SELECT '23', count(*) FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 AND c_custkey % 2 = 0""")
def _(spark, d):
    status = K.maintain(store(spark, d).select("c_custkey", "c_name"), moves(spark, d), "c_custkey", "seq", "act", ["c_name"])[1]
    return status.groupBy("file_status").agg(F.count(F.lit(1)).alias("n"))


for _name, _rel in (("ge", ">="), ("gt", ">"), ("le", "<="), ("lt", "<"), ("eq", "=")):

    @query(f"start_browse_{_name}", f"WITH {STORE_SQL} SELECT c_custkey, c_name FROM store WHERE c_custkey {_rel} 500")
    def _(spark, d, rel=_rel):
        return K.start(store(spark, d).select("c_custkey", "c_name"), "c_custkey", rel, 500)[0]


@query("read_next", f"WITH {STORE_SQL} SELECT c_custkey, c_name FROM store WHERE c_custkey > 100 ORDER BY c_custkey LIMIT 25")
def _(spark, d):
    return K.read_next(store(spark, d).select("c_custkey", "c_name"), "c_custkey", 25, 100)


@query("read_previous", f"WITH {STORE_SQL} SELECT c_custkey, c_name FROM store WHERE c_custkey < 100 ORDER BY c_custkey DESC LIMIT 25")
def _(spark, d):
    return K.read_previous(store(spark, d).select("c_custkey", "c_name"), "c_custkey", 25, 100)


@query("alternate_key_read", """WITH asked AS (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_nationkey < 12 UNION ALL SELECT 'NOWHERE', 1)
SELECT a.c_mktsegment, CAST(a.c_nationkey AS BIGINT) AS c_nationkey, c.c_custkey, CAST(row_number() OVER w AS INT) AS duplicate, CASE WHEN c.c_custkey IS NULL THEN '23' WHEN lead(c.c_custkey) OVER w IS NULL THEN '00' ELSE '02' END AS file_status
FROM asked a LEFT JOIN customer c ON a.c_mktsegment = c.c_mktsegment AND a.c_nationkey = c.c_nationkey WINDOW w AS (PARTITION BY a.c_mktsegment, a.c_nationkey ORDER BY c.c_custkey)""")
def _(spark, d):
    """READ by segment and nation, an alternate key with duplicates, for all pairs of some nations and one that isn't there."""
    rows = table(spark, d, "customer").select(F.col("c_custkey"), "c_mktsegment", F.col("c_nationkey").cast("long").alias("c_nationkey"))
    asked = rows.filter("c_nationkey < 12").select("c_mktsegment", "c_nationkey").distinct().union(spark.createDataFrame([("NOWHERE", 1)], "c_mktsegment string, c_nationkey long"))
    return K.alternate_read(rows, ["c_mktsegment", "c_nationkey"], asked, "c_custkey").select("c_mktsegment", "c_nationkey", "c_custkey", "duplicate", "file_status")


@query("last_dup_wins", "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def _(spark, d):
    return K.load_last(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderkey").alias("pos")), ["o_custkey"], "pos").drop("pos")


@query("fetch_absolute", "SELECT 'fifth' AS w, o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 4) UNION ALL SELECT 'last', max(o_orderkey) FROM orders")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey")
    return K.fetch(rows, ["o_orderkey"], 5).select(F.lit("fifth").alias("w"), "o_orderkey").unionByName(K.fetch(rows, ["o_orderkey"], -1).select(F.lit("last").alias("w"), "o_orderkey"))


@query("table_lookup_search", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return K.lookup(rows, table(spark, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("c_custkey", "n_name")


@query("search_first_match", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'A' WHEN c_acctbal < 1000 THEN 'B' WHEN c_acctbal < 5000 THEN 'C' END AS grade FROM customer")
def _(spark, d):
    grades = F.array(*[F.struct(F.lit(g).alias("g"), F.lit(float(t)).alias("upto")) for g, t in (("A", 0), ("B", 1000), ("C", 5000))])
    return table(spark, d, "customer").select("c_custkey", K.search(grades, lambda e: F.col("c_acctbal") < e["upto"])["g"].alias("grade"))


#: Masters are the store, transactions all orders; the kind follows from the order key.
TX_SQL = """tx AS (SELECT o_orderkey, o_custkey AS k, ['DP', 'WD', 'IN', 'FE'][CAST(o_orderkey % 4 AS INT) + 1] AS kind, CAST(o_totalprice AS DECIMAL(15,2)) AS amt, CAST(strftime(o_orderdate, '%Y%m%d') AS INT) AS dt FROM orders),
work AS (SELECT k, sum(CASE WHEN kind IN ('DP', 'IN') THEN amt ELSE -amt END) AS change, arg_max(dt, o_orderkey) AS last_date, count(*) AS n FROM tx GROUP BY k)"""


def merge_inputs(spark, d):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DP", "WD", "IN", "FE")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    tx = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), kind.alias("kind"), F.col("o_totalprice").cast(MONEY).alias("amt"), F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("dt"))
    return B.match_merge(store(spark, d), tx, "c_custkey", "bal", "kind", "amt", "dt", "o_orderkey")


@query("match_merge_new_master", f"WITH {STORE_SQL}, {TX_SQL} SELECT c_custkey, c_name, CAST(bal + coalesce(change, 0) AS DOUBLE) AS bal, last_date, CAST(coalesce(n, 0) AS BIGINT) AS applied FROM store LEFT JOIN work ON k = c_custkey")
def _(spark, d):
    return merge_inputs(spark, d)[0].withColumn("bal", F.col("bal").cast("double"))


@query("match_merge_exceptions", f"WITH {STORE_SQL}, {TX_SQL} SELECT o_orderkey, k AS c_custkey, kind, CAST(amt AS DOUBLE) AS amt, dt, 'NO MATCHING MASTER' AS reason FROM tx WHERE k NOT IN (SELECT c_custkey FROM store)")
def _(spark, d):
    return merge_inputs(spark, d)[1].withColumn("amt", F.col("amt").cast("double"))


@query("match_merge_counts", f"""WITH {STORE_SQL}, {TX_SQL} SELECT count(*) FILTER (c_custkey IS NOT NULL AND k IS NOT NULL) AS matched, count(*) FILTER (k IS NULL) AS master_only, count(*) FILTER (c_custkey IS NULL) AS transaction_only,
 CAST(coalesce(sum(n) FILTER (c_custkey IS NOT NULL), 0) AS BIGINT) AS applied, CAST(coalesce(sum(n) FILTER (c_custkey IS NULL), 0) AS BIGINT) AS rejected FROM store FULL JOIN work ON k = c_custkey""")
def _(spark, d):
    return merge_inputs(spark, d)[2]


def regions(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", "r_name", "n_name", "c_mktsegment", F.col("c_acctbal").cast(MONEY).alias("bal"))


REGIONS_SQL = "x AS (SELECT c_custkey, r_name, n_name, c_mktsegment, CAST(c_acctbal AS DECIMAL(15,2)) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query("control_break_rollup", f"""WITH {REGIONS_SQL}, t AS (SELECT r_name, n_name, c_mktsegment, count(*) AS row_count, sum(bal) AS total, grouping(r_name) + grouping(n_name) + grouping(c_mktsegment) AS break_level FROM x GROUP BY ROLLUP (r_name, n_name, c_mktsegment))
SELECT r_name, n_name, c_mktsegment, row_count, CAST(total AS DOUBLE) AS total, CAST(break_level AS INT) AS break_level,
       CASE WHEN total < 0 THEN '-' ELSE '' END || lpad(CAST(CAST(abs(total) * 100 AS BIGINT) // 100 AS VARCHAR), 13, '0') || '.' || lpad(CAST(CAST(abs(total) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0') AS text FROM t""")
def _(spark, d):
    """The flagship: totals by segment, nation, region and in all, with the total as a report shows it."""
    totals = B.control_break(regions(spark, d), ["r_name", "n_name", "c_mktsegment"], F.col("bal"))
    return totals.withColumn("text", to_picture(F.col("total"), 15, 2)).withColumn("total", F.col("total").cast("double"))


@query("control_break_detect", f"""WITH {REGIONS_SQL} SELECT c_custkey, row_number() OVER w = 1 AS seg_first, coalesce(lag(c_mktsegment) OVER w <> c_mktsegment, true) AS c_mktsegment_break FROM x WINDOW w AS (PARTITION BY n_name ORDER BY c_mktsegment, c_custkey)""")
def _(spark, d):
    flagged = B.break_flags(regions(spark, d), ["n_name", "c_mktsegment"], ["c_mktsegment", "c_custkey"], "n_name")
    return flagged.select("c_custkey", F.col("n_name_break").alias("seg_first"), "c_mktsegment_break")


@query("page_numbers", f"WITH {REGIONS_SQL} SELECT c_custkey, (rn - 1) % 55 + 1 AS line, (rn - 1) // 55 + 1 AS page FROM (SELECT c_custkey, row_number() OVER (PARTITION BY r_name ORDER BY n_name, c_custkey) AS rn FROM x)")
def _(spark, d):
    return B.page_numbers(regions(spark, d), "r_name", ["n_name", "c_custkey"]).select("c_custkey", "line", "page")


@query("running_balance", "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS balance FROM orders")
def _(spark, d):
    return B.running_balance(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], F.col("o_totalprice").cast(MONEY)).select("o_orderkey", F.col("balance").cast("double").alias("balance"))


@query("commit_groups", "SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 10 AS commit_group FROM orders")
def _(spark, d):
    return B.commit_groups(table(spark, d, "orders"), "o_custkey", ["o_orderkey"], 10).select("o_orderkey", "commit_group")


@query("commit_groups_global", "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS commit_group FROM orders")
def _(spark, d):
    return B.commit_groups_global(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("conversion_progress", "SELECT o_orderkey, CAST(round(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 100.0 / count(*) OVER (PARTITION BY o_custkey)) AS BIGINT) AS percent FROM orders")
def _(spark, d):
    return B.progress(table(spark, d, "orders"), "o_custkey", ["o_orderkey"]).select("o_orderkey", "percent")


@query("counters", "SELECT count(*) FILTER (o_orderstatus = 'O') AS opened, count(*) FILTER (o_orderstatus = 'F') AS filled, count(*) AS total, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS amount, sum(CAST(o_totalprice AS DECIMAL(15,2))) > 99999999.99 AS overflow FROM orders")
def _(spark, d):
    from recordloom.functions.expressions import size_error

    totals = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "O").alias("opened"), F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count(F.lit(1)).alias("total"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("amount"))
    return totals.withColumn("overflow", size_error(F.col("amount"), 8, 2)).withColumn("amount", F.col("amount").cast("double"))


FAULTS_SQL = """f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '   ' WHEN o_orderkey % 13 = 0 THEN 'AB12' ELSE CAST(o_custkey AS VARCHAR) END AS acct, CASE WHEN o_orderkey % 17 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN 9999999999.00 ELSE CAST(o_totalprice AS DECIMAL(15,2)) END AS amt,
 CASE WHEN o_orderkey % 23 = 0 THEN '1995XX01' WHEN o_orderkey % 29 = 0 THEN '19951340' ELSE strftime(o_orderdate, '%Y%m%d') END AS dt, CASE WHEN o_orderkey % 7 = 0 THEN 'ZZ' ELSE 'DP' END AS kind FROM orders),
e AS (SELECT o_orderkey, list_filter([CASE WHEN trim(acct) = '' THEN 'E001' END, CASE WHEN trim(acct) <> '' AND NOT regexp_matches(acct, '^[0-9]+$') THEN 'E002' END, CASE WHEN amt = 0 THEN 'E010' END, CASE WHEN abs(amt) > 999999999.99 THEN 'E011' END, CASE WHEN NOT regexp_matches(dt, '^[0-9]+$') THEN 'E020' END,
 CASE WHEN regexp_matches(dt, '^[0-9]+$') AND NOT dt[5:6] BETWEEN '01' AND '12' THEN 'E021' END, CASE WHEN regexp_matches(dt, '^[0-9]+$') AND NOT dt[7:8] BETWEEN '01' AND '31' THEN 'E022' END, CASE WHEN kind NOT IN ('DP', 'WD', 'IN', 'FE') THEN 'E030' END], lambda c: c IS NOT NULL) AS codes FROM f)"""


def faulty(spark, d):
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(k % 11 == 0, "   ").when(k % 13 == 0, "AB12").otherwise(F.col("o_custkey").cast("string")).alias("acct"),
        F.when(k % 17 == 0, F.lit(0)).when(k % 19 == 0, F.lit("9999999999.00").cast(MONEY)).otherwise(F.col("o_totalprice").cast(MONEY)).alias("amt"),
        F.when(k % 23 == 0, "1995XX01").when(k % 29 == 0, "19951340").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("dt"), F.when(k % 7 == 0, "ZZ").otherwise("DP").alias("kind"),
    )
    return B.validate(rows, B.transaction_rules(F.col("acct"), F.col("amt"), F.col("dt"), F.col("kind")))


@query("validate_records", f"WITH {FAULTS_SQL} SELECT o_orderkey, array_to_string(codes, ',') AS codes, CAST(len(codes) AS BIGINT) AS n FROM e")
def _(spark, d):
    codes = F.transform("errors", lambda e: e["code"])
    return faulty(spark, d).select("o_orderkey", F.array_join(codes, ",").alias("codes"), F.size("errors").cast("long").alias("n"))


@query("valid_error_split", f"WITH {FAULTS_SQL} SELECT 'valid' AS side, count(*) FILTER (len(codes) = 0) AS n FROM e UNION ALL SELECT 'error', count(*) FILTER (len(codes) > 0) FROM e")
def _(spark, d):
    valid, bad = B.split_valid(faulty(spark, d))
    side = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("side"), "n")
    return side(valid, "valid").unionByName(side(bad, "error"))


@query("error_histogram", f"WITH {FAULTS_SQL} SELECT code, count(*) AS n FROM (SELECT unnest(codes) AS code FROM e) GROUP BY code")
def _(spark, d):
    return faulty(spark, d).select(F.explode("errors").alias("e")).groupBy(F.col("e.code").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("job_return_code", f"WITH {FAULTS_SQL} SELECT CASE WHEN count(*) FILTER (len(codes) > 3) > 0 THEN 16 WHEN count(*) FILTER (len(codes) > 0) > 0 THEN 4 ELSE 0 END AS rc FROM e")
def _(spark, d):
    n = F.size("errors")
    return faulty(spark, d).agg(F.count_if(n > 0).alias("w"), F.count_if(n > 3).alias("e")).select(B.return_code(F.col("w"), F.col("e")).alias("rc"))


@query("sort_multi_key", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return B.sort_file(rows, [("o_orderpriority", "ASC"), ("o_totalprice", "DESC"), ("o_orderkey", "ASC")])


@query("sort_input_procedure", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    return B.sort_file(table(spark, d, "orders"), [("o_totalprice", "DESC"), ("o_orderkey", "ASC")], F.col("o_orderstatus") == "F", lambda df: df.select("o_orderkey", (F.col("o_totalprice") * 2).alias("twice")))


@query("merge_files", "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer")
def _(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))
    return B.merge_files([a, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))], ["k", "name"])


for _k in (5, 10, 50):

    @query(f"topk_{_k}", f"SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT {_k}")
    def _(spark, d, k=_k):
        return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "o_custkey").limit(k)


@query("header_trailer_reconcile", "SELECT count(*) AS \"count\", CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS amount, count(*) AS counted, true AS agrees FROM orders")
def _(spark, d):
    from recordloom.sources.files import by_record_type, reconcile_trailer

    orders = table(spark, d, "orders")
    details = orders.select(F.lit("D").alias("code"), F.lit(None).cast("long").alias("count"), F.col("o_totalprice").cast(MONEY).alias("amount"))
    trailer = orders.agg(F.count(F.lit(1)).alias("count"), F.sum(F.col("o_totalprice").cast(MONEY)).alias("amount")).select(F.lit("T").alias("code"), "count", "amount")
    parts = by_record_type(details.unionByName(trailer), F.col("code"), {"detail": "D", "trailer": "T"})
    done = reconcile_trailer(parts["detail"], F.col("amount"), parts["trailer"])
    return done.select("count", F.col("amount").cast("double").alias("amount"), "counted", "agrees")


@query("report_lines", "SELECT CAST((k - 1) // 10 + 1 AS BIGINT) AS page, count(*) AS n_lines, count(*) FILTER (blank) AS blanks FROM (SELECT k, false AS blank FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS k FROM nation) UNION ALL SELECT k, true FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS k FROM nation)) GROUP BY page")
def _(spark, d):
    from recordloom.sources.files import advancing

    lines = advancing(table(spark, d, "nation"), [F.col("n_nationkey")], F.col("n_name"), F.lit(1), lines_per_page=10)
    return lines.groupBy("page").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("text") == "").alias("blanks"))


# ---- embedded SQL

#: A statement for each order, by its key modulo 13; # is the customer's key.
STATEMENTS = (
    "SELECT CUST-NAME INTO :WS-NAME:WS-IND FROM CUST# WHERE CUST_ID = :WS-ID# ORDER BY 1",
    "INSERT INTO ORD# (A, B) VALUES (:WS-A#, :WS-B)",
    "UPDATE ACCT# SET BAL = BAL + :AMT WHERE ID = :WS-ID",
    "DELETE FROM AUDIT.T# WHERE D < :LIMIT-DATE",
    "DECLARE C# CURSOR FOR SELECT A FROM T# JOIN U# ON T#.X = U#.X WHERE T#.Y > # GROUP BY A",
    "OPEN C#", "FETCH C# INTO :A, :B", "CLOSE C#", "COMMIT", "ROLLBACK", "WHENEVER SQLERROR GO TO X", "SAVEPOINT S1", "MERGE INTO Z#",
)


def statements(spark, d):
    orders = table(spark, d, "orders")
    text = F.element_at(F.array(*[F.lit(s) for s in STATEMENTS]), (F.col("o_orderkey") % 13 + 1).cast("int"))
    return orders.select("o_orderkey", F.replace(text, F.lit("#"), F.col("o_custkey").cast("string")).alias("sql"))


def values(rows):
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows) + ")"


def of_orders(rows, *names):
    """SQL of the given rows (id, names) for every order whose key modulo 13 is id, with # as the customer's key."""
    shown = ", ".join(f"replace({n}, '#', CAST(o_custkey AS VARCHAR)) AS {n}" for n in names)
    return f"SELECT o_orderkey, {shown} FROM orders JOIN ({values(rows)} t(id, {', '.join(names)})) t ON o_orderkey % 13 = id"


@query("sql_classify", of_orders(enumerate("SELECT INSERT UPDATE DELETE DECLARE_CURSOR OPEN_CURSOR FETCH CLOSE_CURSOR COMMIT ROLLBACK WHENEVER SAVEPOINT UNKNOWN".split()), "kind"))
def _(spark, d):
    return statements(spark, d).select("o_orderkey", Q.statement_type(F.col("sql")).alias("kind"))


@query("sql_tables", of_orders([(0, "CUST#"), (1, "ORD#"), (2, "ACCT#"), (3, "AUDIT.T#"), (4, "T#"), (4, "U#"), (12, "Z#")], "name"))
def _(spark, d):
    return statements(spark, d).select("o_orderkey", F.explode(Q.tables(F.col("sql"))).alias("name"))


@query("sql_host_vars", of_orders([(0, "WS-NAME", "WS-IND"), (0, "WS-ID#", None), (1, "WS-A#", None), (1, "WS-B", None), (2, "AMT", None), (2, "WS-ID", None), (3, "LIMIT-DATE", None), (6, "A", None), (6, "B", None)], "name", "indicator"))
def _(spark, d):
    return statements(spark, d).select("o_orderkey", F.inline(Q.host_variables(F.col("sql"))))


@query("sql_into_variables", of_orders([(0, "WS-NAME")], "name"))
def _(spark, d):
    return statements(spark, d).select("o_orderkey", F.get(Q.into_variables(F.col("sql")), F.lit(0)).alias("name")).filter("name is not null")


@query("sql_where_cursor", of_orders([(0, "CUST_ID = :WS-ID#", None), (1, None, None), (2, "ID = :WS-ID", None), (3, "D < :LIMIT-DATE", None), (4, "T#.Y > #", "C#"), (5, None, "C#"), (6, None, "C#"), (7, None, "C#"), (8, None, None), (9, None, None), (10, None, None), (11, None, None), (12, None, None)], "cond", "cursor"))
def _(spark, d):
    return statements(spark, d).select("o_orderkey", Q.where_clause(F.col("sql")).alias("cond"), Q.cursor_name(F.col("sql")).alias("cursor"))


@query("select_into", "SELECT * FROM (VALUES ('one', 0, '00000'), ('none', 100, '02000'), ('many', 1, '01000'), ('strict', -811, '21000')) t(asked, sqlcode, sqlstate)")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey")
    first = orders.orderBy("o_orderkey").limit(1)
    found = {"one": Q.select_into(first), "none": Q.select_into(orders.filter("o_orderkey < 0")), "many": Q.select_into(orders), "strict": Q.select_into(orders, strict=True)}
    return spark.createDataFrame([(k, o.sqlcode, o.sqlstate) for k, o in found.items()], "asked string, sqlcode int, sqlstate string")


@query("embedded_query", "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey HAVING count(*) > 1 ORDER BY n DESC, o_custkey LIMIT 20")
def _(spark, d):
    sql = "SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(15,2))) AS DOUBLE) AS total INTO :WS-A, :WS-B FROM t_orders WHERE o_orderstatus = :WS-STATUS GROUP BY o_custkey HAVING count(*) > :MIN-COUNT ORDER BY n DESC, o_custkey FETCH FIRST 20 ROWS ONLY FOR UPDATE"
    return Q.query(spark, sql, {"WS-STATUS": "F", "MIN-COUNT": 1}, t_orders=table(spark, d, "orders"))


@query("cursor_fetch_page", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 15")
def _(spark, d):
    cursor = Q.Cursor(table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").limit(15))
    cursor.open()
    rows = [tuple(r) for r in cursor]
    cursor.close()
    return spark.createDataFrame(rows, "o_orderkey long")


@query("dml_transaction", f"WITH {STORE_SQL} SELECT c_custkey, CAST(CASE WHEN c_custkey % 3 = 0 THEN bal + 1 ELSE bal END AS DOUBLE) AS bal FROM store WHERE bal >= 0")
def _(spark, d):
    tx = Q.Transaction({"acct": store(spark, d).select("c_custkey", "bal")})
    tx.update("acct", {"bal": F.col("bal") + 1}, F.col("c_custkey") % 3 == 0)
    tx.savepoint("s1")
    tx.update("acct", {"bal": F.lit(0)}, F.lit(True))
    tx.rollback_to("s1")
    tx.delete("acct", F.col("bal") < F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0))
    tx.commit()
    return tx.published["acct"].withColumn("bal", F.col("bal").cast("double"))


@query("sqlcode_classify", "SELECT o_orderkey, class, text FROM orders JOIN (VALUES (0, 'success', NULL), (1, 'not_found', 'No data found'), (2, 'warning', NULL), (3, 'error', 'Duplicate key'), (4, 'error', 'SQL error: -1'), (5, 'other', NULL)) t(id, class, text) ON o_orderkey % 6 = id")
def _(spark, d):
    code = F.element_at(F.array(*[F.lit(c) for c in (0, 100, 7, -803, -1, 200)]), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", Q.sqlcode_class(code).alias("class"), Q.sqlcode_text(code).alias("text"))


@query("null_indicator", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 0 END AS ind, CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE o_orderstatus END AS value FROM orders")
def _(spark, d):
    value = F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus"))
    return table(spark, d, "orders").select("o_orderkey", Q.indicator(value).alias("ind"), Q.with_default(value, Q.indicator(value), "N/A").alias("value"))


@query("batch_execute", f"WITH {STORE_SQL} SELECT c.c_custkey, CAST(CASE WHEN s.c_custkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS updated FROM customer c LEFT JOIN store s USING (c_custkey)")
def _(spark, d):
    tx = Q.Transaction({"acct": store(spark, d)})
    params = table(spark, d, "customer").select("c_custkey", F.lit("9.99").cast(MONEY).alias("bal"))
    return tx.batch_update("acct", "c_custkey", params)


@query("exec_blocks", "SELECT o_orderkey, 'SELECT A' || o_custkey || ' INTO :B FROM T' AS body, NULL AS command FROM orders UNION ALL SELECT o_orderkey, 'READ FILE(''CUST' || o_custkey || ''') INTO(WS-REC) RIDFLD(WS-KEY)', 'READ' FROM orders")
def _(spark, d):
    text = "MOVE 1 TO A.\n EXEC SQL\n  SELECT A#\n  INTO :B FROM T\n END-EXEC.\n EXEC CICS READ FILE('CUST#') INTO(WS-REC)\n RIDFLD(WS-KEY) END-EXEC."
    df = table(spark, d, "orders").select("o_orderkey", F.replace(F.lit(text), F.lit("#"), F.col("o_custkey").cast("string")).alias("s"))
    sql = df.select("o_orderkey", F.explode(Q.blocks(F.col("s"))).alias("body"), F.lit(None).cast("string").alias("command"))
    cics = df.select("o_orderkey", F.explode(Q.blocks(F.col("s"), "CICS")).alias("body"))
    return sql.unionByName(cics.withColumn("command", Q.cics_options(F.col("body"))[0]))


@query("rate_windows", "SELECT CAST(epoch(ws) AS BIGINT) AS start, count(*) AS n, count(*) > 100 AS \"over\" FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) - INTERVAL 10 MINUTE * k AS ws FROM events, range(6) r(k)) GROUP BY ws")
def _(spark, d):
    from recordloom.streaming.posting import rate_windows

    return rate_windows(table(spark, d, "events"), "ts", budget=100).select(F.unix_timestamp("start").alias("start"), "n", "over")
