"""The dependency graph as two frames, nodes(name, type) and edges(src, dst, type), and its queries.

Traversals contract the graph (see ``paths``): what a round finds is written to the shared folder, which cuts lineage, and
small frames are broadcast as their sizes are known. Order-dependent results take names in ascending order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators import paths
from recordloom.sources.staged import numbered, settled


def edges_of(programs: DataFrame) -> DataFrame:
    """Distinct CALL and COPY edges of programs (name, calls, copybooks)."""
    of = lambda c, t: programs.select(F.col("name").alias("src"), F.explode(c).alias("dst"), F.lit(t).alias("type"))
    return of("calls", "CALL").unionByName(of("copybooks", "COPY")).distinct()


def missing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Targets of edges that are no nodes, as placeholder nodes (name, type)."""
    targets = edges.groupBy(F.col("dst").alias("name")).agg(F.min(F.when(F.col("type") == "COPY", "copybook").otherwise("program")).alias("type"))
    return targets.join(nodes.select("name"), "name", "left_anti")


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge of any type reaches."""
    return nodes.join(edges.select(F.col("dst").alias("name")).distinct(), "name", "left_anti")


def entry_programs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Programs that no CALL reaches, in any case of letters."""
    called = edges.filter("type = 'CALL'").select(F.upper("dst").alias("key")).distinct()
    return nodes.filter("type = 'program'").withColumn("key", F.upper("name")).join(called, "key", "left_anti").drop("key")


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("type") == "program").alias("programs"), F.count_if(F.col("type") == "copybook").alias("copybooks"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("type") == "CALL").alias("calls"), F.count_if(F.col("type") == "COPY").alias("copies"))
    entry = entry_points(nodes, edges).agg(F.count(F.lit(1)).alias("entry_points"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(n).join(one(e), "k").join(one(entry), "k").drop("k")


def neighbours(edges: DataFrame) -> DataFrame:
    """(name, calls, copybooks, called_by, used_by): counts out and in by type."""
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count_if(F.col("type") == "CALL").alias("calls"), F.count_if(F.col("type") == "COPY").alias("copybooks"))
    into = edges.groupBy(F.col("dst").alias("name")).agg(F.count_if(F.col("type") == "CALL").alias("called_by"), F.count_if(F.col("type") == "COPY").alias("used_by"))
    return out.join(into, "name", "full_outer").fillna(0)


def lookup(edges: DataFrame, name: str) -> DataFrame:
    """Each dependency and dependent of a name, in any case of letters: (relation, other)."""
    key = name.upper()
    out = edges.filter(F.upper("src") == key).select(F.when(F.col("type") == "CALL", "calls").otherwise("copybooks").alias("relation"), F.col("dst").alias("other"))
    into = edges.filter(F.upper("dst") == key).select(F.when(F.col("type") == "CALL", "called_by").otherwise("used_by").alias("relation"), F.col("src").alias("other"))
    return out.unionByName(into).distinct()


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, level): the fewest edges from a root. roots: name. Any number of levels; see ``paths``."""
    roots = roots.select("name").distinct()
    own = paths.with_ends(edges, roots).join(roots.withColumn("value", F.lit(0).cast("long")), "name", "left")
    found = paths.resolve(own, _pairs(edges), paths.Kind(add=True))
    return found.filter("value is not null").select("name", F.col("value").cast("int").alias("level"))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", F.lit(1).cast("long").alias("w")).distinct()


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    return levels(edges, roots).select("name")


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, level): callers have lower levels than what they call. Raises on a cycle."""
    own = paths.with_ends(edges, nodes).withColumn("value", F.lit(0).cast("long"))
    return paths.resolve(own, _pairs(edges), paths.Kind(least=False, add=True, cycle="error")).select("name", F.col("value").cast("int").alias("level"))


def preorder(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(name, position): the order, from 1, in which a depth-first search from the roots, in the order of names, comes to
    the nodes it reaches.

    The search reaches a node over the least of all simple paths to it, by the names along them; and all but the last node
    of that path is such a path too. So paths are bettered edge by edge until none changes, in as many rounds as the search
    is deep, and their order is the search's. A row holds its path."""
    pairs = settled(edges.select("src", "dst").distinct())
    best = frontier = settled(roots.select("name").distinct().withColumn("path", F.array("name")))
    while True:
        longer = frontier.join(pairs, F.col("name") == F.col("src")).filter(~F.array_contains("path", F.col("dst"))).groupBy("dst").agg(F.min(F.array_append("path", F.col("dst"))).alias("_new"))
        frontier = settled(longer.withColumnRenamed("dst", "name").join(best, "name", "left").filter("path is null or _new < path").select("name", F.col("_new").alias("path")))
        if frontier.isEmpty():
            return numbered(best, ["path"], "position").select("name", "position")
        best = settled(best.join(frontier.select("name"), "name", "left_anti").unionByName(frontier))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(name): every node that a cycle reaches and that reaches a cycle: all on cycles, and what lies between cycles.
    What a node that a cycle reaches leads to is reached by that cycle too, so only edges among such nodes are followed
    back."""
    pairs = settled(edges.select("src", "dst").distinct())
    reached = settled(paths.marked(pairs))
    return paths.marked(_among(pairs, reached).select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _among(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """The pairs of which both ends are among the names."""
    return pairs.join(names.select(F.col("name").alias("src")), "src", "left_semi").join(names.select(F.col("name").alias("dst")), "dst", "left_semi")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): nodes that reach each other, named by their least name; a node on no cycle is its own."""
    pairs = settled(edges.select("src", "dst").distinct())
    core = settled(on_cycles(pairs))
    found = settled(paths.strong(core, _among(pairs, core)))
    return paths.with_ends(pairs, nodes).join(found, "name", "left").select("name", F.coalesce("component", "name").alias("component"))


def back_edge_cycles(edges: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """(cycle): a cycle for each edge that leads back to an ancestor, in the tree of fewest edges (and least names) from
    the least name of each strongly connected component; as its nodes from the ancestor on. Every component has one at
    least, and there are no more than edges, however many simple cycles there are. ``component`` is what
    strong_components() gives for the edges, where it is there already."""
    pairs = settled(edges.select("src", "dst").distinct())
    component = settled(strong_components(paths.with_ends(pairs), pairs)) if component is None else component
    of = lambda c, k: component.select(F.col("name").alias(c), F.col("component").alias(k))
    inner = settled(pairs.join(of("src", "_s"), "src").join(of("dst", "_d"), "dst").filter("_s = _d").select("src", "dst", F.col("_s").alias("component")))
    level = settled(levels(inner, inner.select(F.col("component").alias("name"))))
    at = lambda c, k: level.select(F.col("name").alias(c), F.col("level").alias(k))
    placed = settled(inner.join(at("src", "_s"), "src").join(at("dst", "_d"), "dst"))
    parents = settled(placed.filter("_d = _s + 1").groupBy(F.col("dst").alias("name")).agg(F.min("src").alias("up")))
    lifts = paths.lifted(parents, max(1, level.agg(F.max("level")).first()[0] or 0))
    # the ancestor of src at the level of dst: over one power of two after the other
    walk = placed.filter("_d <= _s").select("src", "dst", (F.col("_s") - F.col("_d")).alias("d"), F.col("src").alias("at"))
    for k, up in enumerate(lifts):
        joined = walk.join(up.select(F.col("name").alias("at"), "up"), "at", "left")
        walk = settled(joined.select("src", "dst", "d", F.when(F.shiftright("d", k).bitwiseAND(1) == 1, F.col("up")).otherwise(F.col("at")).alias("at")))
    # pieces (node, steps up it stands for) are halved until each stands for itself
    pieces = walk.filter("at = dst").select("src", "dst", F.col("src").alias("node"), F.lit(0).alias("pos"), (F.col("d") + 1).alias("n"))
    for k, up in reversed(list(enumerate(lifts))):
        step = 1 << k
        joined = pieces.join(up.select(F.col("name").alias("node"), "up"), "node", "left")
        split = F.when(F.col("n") > step, F.array(F.struct("node", "pos", F.lit(step).alias("n")), F.struct(F.col("up").alias("node"), (F.col("pos") + step).alias("pos"), (F.col("n") - step).alias("n")))).otherwise(F.array(F.struct("node", "pos", "n")))
        pieces = settled(joined.select("src", "dst", F.inline(split)))
    return pieces.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("p"), "node"))).alias("c")).select(F.transform("c", lambda x: x["node"]).alias("cycle"))


#: Steps that paths grow between two writes.
STEPS = 6


def cycles(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """(cycle): each simple cycle once, as its nodes from the least name on; with ``longest``, those of at most so many
    nodes. Paths grow until none is left, and a path ends when it meets itself, so steps number the longest path
    among nodes on cycles, and rows the simple paths, which dense graphs have very many of."""
    pairs = settled(edges.select("src", "dst").distinct())
    core = on_cycles(edges)
    pairs = _among(pairs, core)
    following = settled(pairs.groupBy(F.col("src").alias("node")).agg(F.collect_list("dst").alias("next")))
    closed, none = F.col("at") == F.col("first"), F.array().cast("array<string>")

    def grown(paths: DataFrame) -> DataFrame:
        """Every open path by one node; closed ones stay as they are, so a chain of steps is one plan without branches."""
        ahead = F.when(F.array_contains("path", F.col("at")), none).otherwise(F.filter(F.coalesce("next", none), lambda x: x >= F.col("first")))
        joined = paths.join(following, (F.col("at") == F.col("node")) & ~closed, "left")
        return joined.select("first", F.when(closed, F.col("path")).otherwise(F.array_append("path", F.col("at"))).alias("path"), F.explode(F.when(closed, F.array("at")).otherwise(ahead)).alias("at"))

    paths = following.select(F.col("node").alias("first"), F.array("node").alias("path"), F.explode(F.filter("next", lambda x: x >= F.col("node"))).alias("at"))
    found, size = [paths.filter(closed)], 1
    while True:
        paths = paths.filter(~closed)
        for _ in range(STEPS if longest is None else min(STEPS, longest - size)):
            paths, size = grown(paths), size + 1
        paths = settled(paths)
        found.append(paths.filter(closed))
        if size == longest or paths.filter(~closed).isEmpty():
            return reduce(DataFrame.unionByName, found).select(F.col("path").alias("cycle"))


def least_root(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(name, root): the least root that reaches each node; without roots every node is one. This is the component
    that a depth-first search with a shared visited set, started in the order of names, puts the node in."""
    roots = (nodes if roots is None else roots).select("name").distinct()
    own = paths.with_ends(edges, roots).join(roots.select("name", F.col("name").alias("value")), "name", "left")
    return paths.resolve(own, _pairs(edges), paths.Kind()).filter("value is not null").select("name", F.col("value").alias("root"))


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, component): the least of the ``nodes`` connected in either direction."""
    found = paths.connected(paths.with_ends(edges, nodes), edges)
    least = found.join(nodes.select("name").distinct(), "name", "left_semi").groupBy("component").agg(F.min("name").alias("_least"))
    return found.join(least, "component").select("name", F.col("_least").alias("component"))


def call_flows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(flow, programs): from each entry point the programs reached over CALL that no earlier entry point reaches."""
    calls = edges.filter("type = 'CALL'")
    owned = least_root(nodes, calls, entry_points(nodes, edges))
    return owned.groupBy(F.col("root").alias("flow")).agg(F.count(F.lit(1)).alias("size"))


def job_flows(steps: DataFrame) -> DataFrame:
    """(id, name, type, programs, entry_point) from job steps (path, job, step_no, program)."""
    ordered = F.array_sort(F.collect_list(F.struct("step_no", "program")))
    return steps.groupBy("path", F.col("job").alias("name")).agg(ordered.alias("s")).select(F.concat(F.lit("flow-"), F.col("name")).alias("id"), "name", F.lit("batch").alias("type"), F.array_distinct(F.transform("s", lambda x: x["program"])).alias("programs"), F.get(F.transform("s", lambda x: x["program"]), F.lit(0)).alias("entry_point"))


def merge_flows(flows: DataFrame) -> DataFrame:
    """(flow, programs): flows that share a program become one, named by the least of them."""
    member = flows.select("flow", F.explode("programs").alias("program"))
    links = member.join(member.groupBy("program").agg(F.min("flow").alias("least")), "program").select(F.col("flow").alias("src"), F.col("least").alias("dst"), F.lit("SHARE").alias("type")).filter("src <> dst").distinct()
    label = weak_components(flows.select(F.col("flow").alias("name")), links)
    return flows.join(label, flows.flow == label.name).groupBy(F.col("component").alias("flow")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("programs")))).alias("programs"))


def hierarchical_layout(nodes: DataFrame, edges: DataFrame, level_gap: int = 250, node_gap: int = 150) -> DataFrame:
    """(name, level, x, y): levels over CALL edges from the programs that nothing calls; the others go one below."""
    calls = edges.filter("type = 'CALL'")
    placed = levels(calls, entry_programs(nodes, edges))
    below = placed.agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("below")).first()[0]
    every = nodes.select("name").join(placed, "name", "left").withColumn("level", F.coalesce("level", F.lit(below)))
    width = every.groupBy("level").agg(F.count(F.lit(1)).alias("width"))
    placed = numbered(every.select("name", "level"), ["name"], "nth", ["level"]).join(width, "level")
    return placed.select("name", "level", ((F.col("nth") - 1) * node_gap - (F.col("width") - 1) * node_gap / 2).alias("x"), (F.col("level") * level_gap).cast("double").alias("y"))


def circular_layout(nodes: DataFrame) -> DataFrame:
    """(name, x, y) on a circle in the order of names. Positions come from a distributed sort, not from one task."""
    n = nodes.count()
    radius = float(max(200, n * 30))
    angle: Column = (F.col("nth") - 1) * (2 * 3.141592653589793 / max(n, 1))
    return numbered(nodes.select("name"), ["name"], "nth").select("name", (F.cos(angle) * radius).alias("x"), (F.sin(angle) * radius).alias("y"))


def most_called(edges: DataFrame, k: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("name"), "type").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "name", "type").limit(k)


def connections(programs: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, connections): edges out, or the sizes of both arrays if there are none."""
    out = edges.groupBy(F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return programs.join(out, "name", "left").select("name", F.coalesce("n", (F.size("calls") + F.size("copybooks")).cast("long")).alias("connections"))


def copybook_usage(edges: DataFrame) -> DataFrame:
    return edges.filter("type = 'COPY'").groupBy(F.col("dst").alias("name")).agg(F.count_distinct("src").alias("users"), F.count(F.lit(1)).alias("uses"))


def summary(programs: DataFrame, flows: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = programs.select("name", F.when(F.col("type") == "copybook", "copybook").otherwise("program").alias("type"))
    one = lambda df: df.withColumn("k", F.lit(1))
    p = programs.agg(F.count_if(F.col("type") == "cobol").alias("programs"), F.count_if(F.col("type") == "copybook").alias("copybooks"), F.count_if(F.col("type") == "jcl").alias("jcl_files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("total_lines"))
    f = flows.agg(F.count_if(F.col("type") == "batch").alias("batch_flows"))
    e = edges.agg(F.count(F.lit(1)).alias("dependencies"))
    n = entry_points(nodes, edges).agg(F.count(F.lit(1)).alias("entry_points"))
    return one(p).join(one(f), "k").join(one(e), "k").join(one(n), "k").drop("k")
