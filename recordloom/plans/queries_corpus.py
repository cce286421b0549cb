"""Source-corpus analytics and graph queries; sources and graphs are synthesised from part rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordloom.operators import corpus as S
from recordloom.operators import graph as G
from recordloom.plans.registry import Registry, table
from recordloom.sources import files
from recordloom.sources.staged import settled

query = Registry()

#: A program for each part: calls of 2k and 2k + 1 (one of them twice), a copy of k mod 10, a false positive after END-CALL.
SOURCE_SQL = """src AS (SELECT p_partkey AS k, 'P' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '.cpy' WHEN p_partkey % 3 = 1 THEN '.cbl' ELSE '.jcl' END AS path FROM part)"""


def sources(spark, d):
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    ext = F.when(k % 3 == 0, ".cpy").when(k % 3 == 1, ".cbl").otherwise(".jcl")
    content = F.concat(
        F.lit("       IDENTIFICATION DIVISION.\n       PROGRAM-ID. P"), s(k), F.lit(".\n       AUTHOR. TEAM-"), s(k % 5), F.lit(".\n       DATA DIVISION.\n           COPY CB"), s(k % 10),
        F.lit(".\n       PROCEDURE DIVISION.\n           CALL 'P"), s(2 * k), F.lit("' END-CALL\n           DISPLAY 'X'\n      *    CALL 'GHOST'.\n           CALL 'P"), s(2 * k + 1), F.lit("'.\n           CALL 'P"), s(2 * k), F.lit("'."),
    )
    return table(spark, d, "part").select(k.alias("k"), F.concat(F.lit("P"), s(k), ext).alias("path"), content.alias("content"))


@query("extract_calls", "SELECT p_partkey AS k, 'P' || 2 * p_partkey || ',DISPLAY,GHOST,P' || (2 * p_partkey + 1) AS loose, 'P' || 2 * p_partkey || ',P' || (2 * p_partkey + 1) AS strict FROM part")
def _(spark, d):
    c = F.col("content")
    return sources(spark, d).select("k", F.array_join(S.calls(c), ",").alias("loose"), F.array_join(S.calls(c, strict=True), ",").alias("strict"))


@query("extract_copies", "SELECT p_partkey AS k, 'CB' || p_partkey % 10 AS name, 'P' || p_partkey AS program, 'TEAM-' || p_partkey % 5 AS author FROM part")
def _(spark, d):
    c = F.col("content")
    return sources(spark, d).select("k", F.explode(S.copies(c)).alias("name"), S.identification(c)["program_id"].alias("program"), S.identification(c)["author"].alias("author"))


@query("division_flags", "SELECT p_partkey AS k, true AS i, false AS e, true AS dd, true AS p, CAST(11 AS BIGINT) AS n FROM part")
def _(spark, d):
    f = S.divisions(F.col("content"))
    return sources(spark, d).select("k", f["has_identification"].alias("i"), f["has_environment"].alias("e"), f["has_data"].alias("dd"), f["has_procedure"].alias("p"), S.line_count(F.col("content")).alias("n"))


@query("file_type_counts", f"WITH {SOURCE_SQL} SELECT CASE WHEN path LIKE '%.cbl' THEN 'cobol' WHEN path LIKE '%.cpy' THEN 'copybook' ELSE 'jcl' END AS type, count(*) AS n FROM src GROUP BY 1")
def _(spark, d):
    return sources(spark, d).groupBy(files.file_type(F.col("path")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def jobs(spark, d):
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("//JOB"), k, F.lit(" JOB (ACCT)\n//STEP1 EXEC PGM=PA"), k, F.lit("\n//DD1 DD DSN=X\n//STEP2 EXEC PGM=PB"), (F.col("s_suppkey") % 7).cast("string"), F.lit(",COND=(0,NE)\n//STEP3 EXEC PGM=PC\n// COND=(4,LT)\n"))
    return table(spark, d, "supplier").select(F.concat(k, F.lit(".jcl")).alias("path"), text.alias("content"))


@query("jcl_steps", "SELECT s_suppkey || '.jcl' AS path, 'JOB' || s_suppkey AS job, CAST(n AS BIGINT) AS step_no, 'STEP' || n AS step, CASE n WHEN 1 THEN 'PA' || s_suppkey WHEN 2 THEN 'PB' || s_suppkey % 7 ELSE 'PC' END AS program, CASE n WHEN 2 THEN 'COND=(0,NE)' WHEN 3 THEN 'COND=(4,LT)' END AS cond FROM supplier, (SELECT unnest([1, 2, 3]) AS n)")
def _(spark, d):
    return S.job_steps(jobs(spark, d))


@query("jcl_flows", "SELECT 'flow-JOB' || s_suppkey AS id, 'JOB' || s_suppkey AS name, 'batch' AS type, 'PA' || s_suppkey || ',PB' || s_suppkey % 7 || ',PC' AS programs, 'PA' || s_suppkey AS entry_point FROM supplier")
def _(spark, d):
    return G.job_flows(S.job_steps(jobs(spark, d))).withColumn("programs", F.array_join("programs", ","))


@query("flow_merge", "SELECT 'JOB' || min(s_suppkey::VARCHAR) AS flow, CAST(count(*) + 2 AS BIGINT) AS n FROM supplier GROUP BY s_suppkey % 7")
def _(spark, d):
    flows = table(spark, d, "supplier").select(F.concat(F.lit("JOB"), F.col("s_suppkey").cast("string")).alias("flow"), F.array(F.concat(F.lit("PA"), F.col("s_suppkey").cast("string")), F.concat(F.lit("PB"), (F.col("s_suppkey") % 7).cast("string")), F.concat(F.lit("Q"), (F.col("s_suppkey") % 7).cast("string"))).alias("programs"))
    return G.merge_flows(flows).select("flow", F.size("programs").cast("long").alias("n"))


@query("source_metrics", "SELECT p_partkey AS k, 'fixed' AS format, CAST(11 AS BIGINT) AS line_count, CAST(35 AS BIGINT) AS token_count FROM part")
def _(spark, d):
    src = sources(spark, d)
    return S.metrics(src.withColumn("path", F.col("k").cast("string"))).select(F.col("path").cast("long").alias("k"), "format", "line_count", "token_count")


@query("fixed_format_lines", "SELECT p_partkey AS k, CAST(0 AS INT) AS line_no, 'MOVE ''A' || p_partkey || 'B'' TO X.' AS code FROM part UNION ALL SELECT p_partkey, 3, 'STOP RUN.' FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("000100 MOVE 'A"), k, F.lit("\n000200-    'B' TO X.\n000300* NOTE\n000400 STOP RUN.\n000500D DEBUG"))
    df = table(spark, d, "part").select(k.alias("path"), text.alias("content"))
    return S.fixed_lines(df).select(F.col("path").cast("long").alias("k"), "line_no", "code")


@query("free_format_lines", "SELECT p_partkey AS k, 'MOVE ' || p_partkey || ' TO X.' AS code FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    df = table(spark, d, "part").select(k.alias("path"), F.concat(F.lit(">>SOURCE FREE\nMOVE "), k, F.lit(" TO X. *> note\n*> all note\n")).alias("content"))
    return S.free_lines(df).select(F.col("path").cast("long").alias("k"), "code")


@query("copy_statements", "SELECT p_partkey AS k, 'CB1' AS name, 'LIB' || p_partkey % 3 AS library, '==A== BY ==B==' AS replacing FROM part")
def _(spark, d):
    text = F.concat(F.lit("COPY CB1 OF LIB"), (F.col("p_partkey") % 3).cast("string"), F.lit(" REPLACING ==A== BY ==B==."))
    return table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.inline(S.copy_statements(text)))


@query("source_validation", "SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 'Missing PROGRAM-ID' ELSE '' END AS errors, CASE WHEN p_partkey % 4 = 0 THEN 'No procedures found' ELSE '' END AS warnings FROM part")
def _(spark, d):
    src = sources(spark, d).select(F.col("k").cast("string").alias("path"), F.when(F.col("k") % 4 == 0, "EMPTY").otherwise(F.col("content")).alias("content"))
    return S.validate_source(src).select(F.col("path").cast("long").alias("k"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"))


@query("section_parse", "SELECT p_partkey AS k, contains('COPY CB' || p_partkey % 10, 'COPY') AS has_copy, false AS data_calls FROM part")
def _(spark, d):
    part = S.sections(F.col("content"))["data"]
    return sources(spark, d).select("k", F.contains(part, F.lit("COPY CB")).alias("has_copy"), F.contains(part, F.lit("CALL")).alias("data_calls"))


@query("file_control", "SELECT p_partkey || '.cbl' AS path, 'F' || p_partkey AS file, 'CUST.DAT' AS assign, 'INDEXED' AS organization, 'DYNAMIC' AS access, 'K1' AS record_key, 'FS' AS status FROM part")
def _(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.lit("FILE-CONTROL.\n SELECT F"), k, F.lit(" ASSIGN TO 'CUST.DAT'\n ORGANIZATION IS INDEXED ACCESS MODE IS DYNAMIC\n RECORD KEY IS K1 FILE STATUS IS FS."))
    return files.file_control(spark, table(spark, d, "part").select(F.concat(k, F.lit(".cbl")).alias("path"), text.alias("content")))


@query("url_parts", r"SELECT page_id, regexp_extract(url, '^\w+://[^/]+/([^/]+)/([^/?#]+)', 1) AS owner, regexp_extract(url, '^\w+://[^/]+/([^/]+)/([^/?#]+)', 2) AS repo, regexp_matches(url, '^\w+://[^/]+/[^/]+/[^/?#]+') AS valid FROM pages")
def _(spark, d):
    r = S.repository(F.col("url"), r"[^/:@]+")
    return table(spark, d, "pages").select("page_id", F.coalesce(r["owner"], F.lit("")).alias("owner"), F.coalesce(r["repo"], F.lit("")).alias("repo"), r["valid"].alias("valid"))


@query("default_branch", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'dev' ELSE 'main' END AS branch FROM nation")
def _(spark, d):
    existing = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("main"), F.lit("dev"))).otherwise(F.array(F.lit("main")))
    return table(spark, d, "nation").select("n_nationkey", S.default_branch(F.lit("dev"), existing, F.lit("main")).alias("branch"))


@query("program_search", f"WITH {SOURCE_SQL} SELECT 'P' || k AS name, path FROM src WHERE path LIKE '%.cbl' AND ('P' || k) LIKE '%12%'")
def _(spark, d):
    return S.search_programs(S.programs(sources(spark, d)), "p12", None).filter("type = 'cobol'").select("name", "path").unionByName(S.search_programs(S.programs(sources(spark, d)), "12", "cobol").select("name", "path")).distinct()


# ---- the graph: nodes are part keys plus one; CALL k -> 2k and 2k + 1, COPY k -> CB(k mod 10)

GRAPH_SQL = """n AS (SELECT p_partkey + 1 AS k FROM part),
e AS (SELECT DISTINCT k AS s, t, kind FROM (SELECT k, 2 * k AS t, 'CALL' AS kind FROM n UNION ALL SELECT k, 2 * k + 1, 'CALL' FROM n UNION ALL SELECT k, -1 - (k % 10), 'COPY' FROM n))"""
NAME_SQL = "CASE WHEN {0} < 0 THEN 'CB' || (-1 - {0}) ELSE 'P' || lpad(CAST({0} AS VARCHAR), 9, '0') END"


def name(k):
    return F.concat(F.lit("P"), F.lpad(k.cast("string"), 9, "0"))


def graph(spark, d):
    parts = table(spark, d, "part")
    k = F.col("p_partkey") + 1
    programs = parts.select(name(k).alias("name"), F.array(name(2 * k), name(2 * k + 1)).alias("calls"), F.array(F.concat(F.lit("CB"), (k % 10).cast("string"))).alias("copybooks"))
    return programs, programs.select("name", F.lit("program").alias("type")), G.edges_of(programs)


def nm(x):
    return NAME_SQL.format(x)


@query("graph_edges", f"WITH {GRAPH_SQL} SELECT {nm('s')} AS src, {nm('t')} AS dst, kind AS type FROM e")
def _(spark, d):
    return graph(spark, d)[2]


@query("graph_stats", f"WITH {GRAPH_SQL} SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n) AS programs, CAST(0 AS BIGINT) AS copybooks, count(*) AS edges, count(*) FILTER (kind = 'CALL') AS calls, count(*) FILTER (kind = 'COPY') AS copies, (SELECT count(*) FROM n WHERE k NOT IN (SELECT t FROM e)) AS entry_points FROM e")
def _(spark, d):
    return G.statistics(*graph(spark, d)[1:])


@query("graph_entry_points", f"WITH {GRAPH_SQL} SELECT {nm('k')} AS name, 'program' AS type FROM n WHERE k NOT IN (SELECT t FROM e)")
def _(spark, d):
    return G.entry_points(*graph(spark, d)[1:])


@query("graph_entry_programs", f"WITH {GRAPH_SQL} SELECT {nm('k')} AS name, 'program' AS type FROM n WHERE k NOT IN (SELECT t FROM e WHERE kind = 'CALL')")
def _(spark, d):
    return G.entry_programs(*graph(spark, d)[1:])


@query("graph_missing", f"WITH {GRAPH_SQL} SELECT DISTINCT {nm('t')} AS name, CASE kind WHEN 'COPY' THEN 'copybook' ELSE 'program' END AS type FROM e WHERE t NOT IN (SELECT k FROM n)")
def _(spark, d):
    return G.missing(*graph(spark, d)[1:])


@query("graph_neighbours", f"WITH {GRAPH_SQL} SELECT {nm('x')} AS name, CAST(sum(a) AS BIGINT) AS calls, CAST(sum(b) AS BIGINT) AS copybooks, CAST(sum(c) AS BIGINT) AS called_by, CAST(sum(f) AS BIGINT) AS used_by FROM (SELECT s AS x, (kind = 'CALL')::INT AS a, (kind = 'COPY')::INT AS b, 0 AS c, 0 AS f FROM e UNION ALL SELECT t, 0, 0, (kind = 'CALL')::INT, (kind = 'COPY')::INT FROM e) GROUP BY x")
def _(spark, d):
    return G.neighbours(graph(spark, d)[2])


@query("graph_lookup", f"WITH {GRAPH_SQL} SELECT CASE kind WHEN 'CALL' THEN 'calls' ELSE 'copybooks' END AS relation, {nm('t')} AS other FROM e WHERE s = 10 UNION SELECT CASE kind WHEN 'CALL' THEN 'called_by' ELSE 'used_by' END, {nm('s')} FROM e WHERE t = 10")
def _(spark, d):
    return G.lookup(graph(spark, d)[2], "p000000010")


@query("graph_bfs_levels", f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT k AS x, 0 AS level FROM n WHERE k NOT IN (SELECT t FROM e) UNION SELECT t, level + 1 FROM r JOIN e ON s = x)
SELECT {nm('x')} AS name, CAST(min(level) AS INT) AS level FROM r GROUP BY x""")
def _(spark, d):
    _, nodes, edges = graph(spark, d)
    return G.levels(edges, G.entry_points(nodes, edges))


@query("graph_reachable", f"WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT CAST(3 AS BIGINT) AS x UNION SELECT t FROM r JOIN e ON s = x) SELECT {nm('x')} AS name FROM r")
def _(spark, d):
    edges = graph(spark, d)[2]
    return G.reachable(edges, spark.createDataFrame([("P000000003",)], "name string"))


@query("graph_topo_levels", f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT k AS x, 0 AS level FROM n WHERE k NOT IN (SELECT t FROM e) UNION SELECT t, level + 1 FROM r JOIN e ON s = x)
SELECT {nm('x')} AS name, CAST(max(level) AS INT) AS level FROM r GROUP BY x""")
def _(spark, d):
    return G.topological_levels(*graph(spark, d)[1:])


def cyclic(spark, d):
    """k -> k + 1 within groups of three, and the third back to the first."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(name(k).alias("src"), name(F.when(k % 3 == 2, k - 2).otherwise(k + 1)).alias("dst"), F.lit("CALL").alias("type"))


@query("graph_cycles", "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ',P' || lpad(CAST(p_partkey + 1 AS VARCHAR), 9, '0') || ',P' || lpad(CAST(p_partkey + 2 AS VARCHAR), 9, '0') AS cycle FROM part WHERE p_partkey % 3 = 0 AND p_partkey + 2 <= (SELECT max(p_partkey) FROM part)")
def _(spark, d):
    return G.cycles(cyclic(spark, d)).select(F.array_join("cycle", ",").alias("cycle"))


@query("graph_long_cycles", "SELECT string_agg('P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0'), ',' ORDER BY p_partkey) AS cycle FROM part GROUP BY p_partkey // 12 HAVING count(*) = 12")
def _(spark, d):
    """Rings of twelve programs."""
    k = F.col("p_partkey")
    ring = table(spark, d, "part").select(name(k).alias("src"), name(F.when(k % 12 == 11, k - 11).otherwise(k + 1)).alias("dst"))
    return G.cycles(ring).select(F.array_join("cycle", ",").alias("cycle"))


SQUARES_SQL = "RECURSIVE m AS (SELECT max(s_suppkey) + 1 AS m FROM supplier), e AS (SELECT s_suppkey AS s, (s_suppkey * s_suppkey + 1) % m AS t FROM supplier, m), n AS (SELECT s AS x FROM e UNION SELECT t FROM e)"
TANGLED_SQL = SQUARES_SQL.replace("FROM supplier, m)", "FROM supplier, m UNION SELECT s_suppkey, s_suppkey + 1 FROM supplier WHERE s_suppkey % 4 = 1 UNION SELECT s_suppkey, s_suppkey // 2 FROM supplier WHERE s_suppkey % 3 = 0)")
REACH_SQL = "r AS (SELECT x AS a, x AS b FROM n UNION SELECT a, t FROM r JOIN e ON s = b)"


def squares(spark, d, tangled=False):
    """Calls among suppliers to the square's remainder: trees that lead into cycles. If ``tangled``, some also call the next
    one and the half, so cycles share nodes."""
    suppliers = table(spark, d, "supplier")
    k, m = F.col("s_suppkey"), F.lit(suppliers.agg(F.max("s_suppkey")).first()[0] + 1)
    to = lambda when, dst: suppliers.filter(when).select(name(k).alias("src"), name(dst).alias("dst"), F.lit("CALL").alias("type"))
    own = to(F.lit(True), (k * k + 1) % m)
    return own.unionByName(to(k % 4 == 1, k + 1)).unionByName(to(k % 3 == 0, F.floor(k / 2))).distinct() if tangled else own


@query("graph_scc", f"WITH {SQUARES_SQL}, {REACH_SQL} SELECT {nm('a.a')} AS name, {nm('min(a.b)')} AS component FROM r a JOIN r b ON a.a = b.b AND a.b = b.a GROUP BY a.a")
def _(spark, d):
    edges = squares(spark, d)
    return G.strong_components(edges.select(F.col("src").alias("name")), edges)


@query("graph_tangled_levels", f"WITH {TANGLED_SQL}, l AS (SELECT min(x) AS x, 0 AS level FROM n UNION SELECT t, level + 1 FROM l JOIN e ON s = x WHERE level < (SELECT count(*) FROM n)) SELECT {nm('x')} AS name, CAST(min(level) AS INT) AS level FROM l GROUP BY x")
def _(spark, d):
    """The fewest calls from the first supplier, in a graph of cycles."""
    edges = squares(spark, d, tangled=True)
    ends = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    return G.levels(edges, ends.agg(F.min("name").alias("name")))


@query("graph_back_edges", f"WITH {SQUARES_SQL}, {REACH_SQL}, c AS (SELECT a.a AS x, min(a.b) AS c FROM r a JOIN r b ON a.a = b.b AND a.b = b.a GROUP BY a.a) SELECT {nm('c')} AS component, count(*) AS nodes FROM c GROUP BY c HAVING count(*) > 1 OR bool_or(EXISTS (SELECT 1 FROM e WHERE s = x AND t = x))")
def _(spark, d):
    """The components that the cycles of back edges are of, with the number of their nodes: each has a cycle at least."""
    edges = squares(spark, d)
    component = settled(G.strong_components(edges.select(F.col("src").alias("name")), edges))
    found = G.back_edge_cycles(edges, component).select(F.explode("cycle").alias("name")).distinct().join(component, "name").select("component").distinct()
    return component.join(found, "component").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))


@query("graph_preorder", f"""WITH RECURSIVE {GRAPH_SQL}, p AS (SELECT {nm('k')} AS x, [{nm('k')}] AS path FROM n WHERE k NOT IN (SELECT t FROM e) UNION ALL SELECT {nm('t')}, list_append(path, {nm('t')}) FROM p JOIN e ON {nm('s')} = x)
SELECT x AS name, row_number() OVER (ORDER BY path) AS position FROM (SELECT x, min(path) AS path FROM p GROUP BY x)""")
def _(spark, d):
    _, nodes, edges = graph(spark, d)
    return G.preorder(edges, G.entry_points(nodes, edges))


@query("graph_on_cycles", "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name FROM part WHERE p_partkey - p_partkey % 3 + 2 <= (SELECT max(p_partkey) FROM part)")
def _(spark, d):
    return G.on_cycles(cyclic(spark, d))


@query("graph_components", f"WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT k AS root, k AS x FROM n UNION SELECT root, t FROM r JOIN e ON s = x AND kind = 'CALL') SELECT {nm('x')} AS name, {nm('min(root)')} AS root FROM r GROUP BY x")
def _(spark, d):
    _, nodes, edges = graph(spark, d)
    return G.least_root(nodes, edges.filter("type = 'CALL'"))


@query("graph_weak_components", "SELECT 'P' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS name, 'P' || lpad(CAST(p_partkey - p_partkey % 3 AS VARCHAR), 9, '0') AS component FROM part WHERE p_partkey - p_partkey % 3 + 2 <= (SELECT max(p_partkey) FROM part)")
def _(spark, d):
    edges = cyclic(spark, d)
    inner = edges.join(G.on_cycles(edges).select(F.col("name").alias("src")), "src", "left_semi")
    return G.weak_components(inner.select(F.col("src").alias("name")), inner)


@query("graph_flows", f"WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT k AS root, k AS x FROM n WHERE k NOT IN (SELECT t FROM e) UNION SELECT root, t FROM r JOIN e ON s = x AND kind = 'CALL') SELECT {nm('root')} AS flow, count(*) AS size FROM (SELECT x, min(root) AS root FROM r GROUP BY x) GROUP BY root")
def _(spark, d):
    return G.call_flows(*graph(spark, d)[1:])


@query("graph_layout", f"""WITH RECURSIVE {GRAPH_SQL}, r AS (SELECT k AS x, 0 AS level FROM n WHERE k NOT IN (SELECT t FROM e WHERE kind = 'CALL') UNION SELECT t, level + 1 FROM r JOIN e ON s = x AND kind = 'CALL'), l AS (SELECT x, min(level) AS level FROM r GROUP BY x)
SELECT {nm('k')} AS name, CAST(level AS INT) AS level, CAST((row_number() OVER (PARTITION BY level ORDER BY k) - 1) * 150 - (count(*) OVER (PARTITION BY level) - 1) * 150 / 2.0 AS DOUBLE) AS x, CAST(level * 250 AS DOUBLE) AS y FROM n JOIN l ON x = k""")
def _(spark, d):
    _, nodes, edges = graph(spark, d)
    return G.hierarchical_layout(nodes, edges).withColumn("x", F.col("x").cast("double"))


@query("graph_circular_layout", "SELECT n_name AS name, round(cos((row_number() OVER (ORDER BY n_name) - 1) * 2 * pi() / 25) * 750, 6) AS x, round(sin((row_number() OVER (ORDER BY n_name) - 1) * 2 * pi() / 25) * 750, 6) AS y FROM nation")
def _(spark, d):
    return G.circular_layout(table(spark, d, "nation").select(F.col("n_name").alias("name"))).select("name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("graph_most_called", f"WITH {GRAPH_SQL} SELECT {nm('t')} AS name, kind AS type, count(*) AS uses FROM e GROUP BY t, kind ORDER BY uses DESC, name, type LIMIT 10")
def _(spark, d):
    return G.most_called(graph(spark, d)[2])


@query("graph_connections", f"WITH {GRAPH_SQL} SELECT {nm('k')} AS name, CAST(3 AS BIGINT) AS connections FROM n")
def _(spark, d):
    programs, _, edges = graph(spark, d)
    return G.connections(programs, edges)


@query("copybook_usage", f"WITH {GRAPH_SQL} SELECT {nm('t')} AS name, count(DISTINCT s) AS users, count(*) AS uses FROM e WHERE kind = 'COPY' GROUP BY t")
def _(spark, d):
    return G.copybook_usage(graph(spark, d)[2])


@query("corpus_summary", f"WITH {SOURCE_SQL} SELECT count(*) FILTER (path LIKE '%.cbl') AS programs, count(*) FILTER (path LIKE '%.cpy') AS copybooks, count(*) FILTER (path LIKE '%.jcl') AS jcl_files, CAST(count(*) * 11 AS BIGINT) AS total_lines, (SELECT count(*) FROM supplier) AS batch_flows, CAST(5 * count(*) FILTER (path LIKE '%.cbl') AS BIGINT) AS dependencies FROM src")
def _(spark, d):
    programs = S.programs(sources(spark, d))
    edges = G.edges_of(programs)
    return G.summary(programs, G.job_flows(S.job_steps(jobs(spark, d))), edges).drop("entry_points")


@query("programs_with_calls", f"WITH {GRAPH_SQL} SELECT {nm('k')} AS name FROM n WHERE k IN (SELECT s FROM e WHERE kind = 'CALL')")
def _(spark, d):
    _, nodes, edges = graph(spark, d)
    return nodes.join(edges.filter("type = 'CALL'").select(F.col("src").alias("name")).distinct(), "name", "left_semi").select("name")


@query("program_sort", f"WITH {SOURCE_SQL} SELECT 'P' || k AS name, CASE WHEN path LIKE '%.cbl' THEN 4 ELSE 0 END AS n_calls FROM src ORDER BY n_calls DESC, name")
def _(spark, d):
    programs = S.programs(sources(spark, d)).filter("type <> 'jcl'").unionByName(S.programs(sources(spark, d)).filter("type = 'jcl'"))
    return programs.select("name", F.size("calls").alias("n_calls")).orderBy(F.desc("n_calls"), "name")
