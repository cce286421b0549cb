"""Values along the paths of a directed graph, in few rounds.

What a node gets is the best (least or greatest) of its own value and of what its predecessors hand on: that is distances
(add one, least), levels of a topological order (add one, greatest) and the least root that reaches a node (hand on,
least). Following one edge a round takes as many rounds as the longest path, so the graph is contracted:

* a node with one predecessor gets what that one hands on, so it becomes a pointer, and pointers are doubled until they
  end at a node that is none: a chain or a tree of any depth takes the logarithm of its depth;
* a node without predecessors is done, and hands its value on at once.

Both shorten what is left, and make other nodes such ones. If neither is there, every node that is left has several
predecessors and follows a cycle: then values travel edge by edge until nothing changes. Contracted nodes are resolved in
reverse. Each round is a few joins whose results are written, so lineage is short and sizes are known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.sources.staged import settled


#: Edges that values travel between two writes.
HOPS = 3


@dataclass(frozen=True)
class Kind:
    """Least or greatest values, adding the edges' weights or not; what a cycle means: values "travel" on it, it is an
    "error", or its nodes get the value "mark"."""

    least: bool = True
    add: bool = False
    cycle: str = "travel"

    def best(self, *columns: Column) -> Column:
        return (F.least if self.least else F.greatest)(*columns)

    def aggregated(self, column: str | Column) -> Column:
        return (F.min if self.least else F.max)(column)

    def on(self, value: Column, w: Column) -> Column:
        return value + w if self.add else value


def resolve(own: DataFrame, edges: DataFrame, kind: Kind) -> DataFrame:
    """(name, value) for all of ``own`` (name, value; null where a node has none) along ``edges`` (src, dst, w). Every end
    of an edge has to be among the names."""
    own, later = settled(own), []
    edges = _merged(edges, kind)
    while True:
        count, looped = edges.agg(F.count(F.lit(1)), F.count_if(F.col("src") == F.col("dst"))).first()
        if kind.cycle != "travel" and looped:
            if kind.cycle == "error":
                raise ValueError("the graph has a cycle")
            own = _offered(own, edges.filter("src = dst").select(F.col("dst").alias("name"), F.lit(0).alias("value")), kind)
        if count == looped:
            break
        edges = edges.filter("src <> dst")
        into = settled(edges.groupBy(F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("top"), F.first("w").alias("w")))
        single = into.filter("n = 1").drop("n")
        # nodes without predecessors are done
        ends = edges.select(F.col("src").alias("name")).distinct().join(into.select("name"), "name", "left_anti").join(own, "name")
        if single.isEmpty() and ends.isEmpty():
            own = _travel(own, edges, into, kind)
            break
        pointers = doubled(single.join(own, "name").withColumnRenamed("value", "b"), kind)
        later.append(pointers)
        # edges into nodes of several predecessors begin where the pointer of their source ends
        moved = edges.join(into.filter("n > 1").select(F.col("name").alias("dst")), "dst", "left_semi").join(pointers.select(F.col("name").alias("src"), F.lit(True).alias("_p"), "top", F.col("w").alias("_w"), "b"), "src", "left")
        moved = moved.select(F.when(F.col("_p"), F.col("top")).otherwise(F.col("src")).alias("src"), "dst", F.when(F.col("_p") & F.col("top").isNotNull(), F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"), kind.on(F.col("b"), F.col("w")).alias("value"))
        moved = settled(moved.join(ends.select(F.col("name").alias("src"), F.lit(True).alias("_end"), F.col("value").alias("_own")), "src", "left").withColumn("value", kind.best(F.col("value"), kind.on(F.col("_own"), F.col("w")))))
        offers, go_on = moved.agg(F.count("value"), F.count_if(F.col("src").isNotNull() & F.col("_end").isNull())).first()
        if offers:
            own = _offered(own, moved.filter("value is not null").select(F.col("dst").alias("name"), "value"), kind)
        if not go_on:
            break
        edges = _merged(moved.filter("src is not null and _end is null").select("src", "dst", "w"), kind)
    for pointers in reversed(later):
        tops = own.select(F.col("name").alias("top"), F.col("value").alias("_top"))
        found = pointers.join(tops, "top", "left").select("name", kind.best(F.col("b"), kind.on(F.col("_top"), F.col("w"))).alias("_new"))
        own = own.join(found, "name", "left").select("name", kind.best(F.col("value"), F.col("_new")).alias("value"))
    return settled(own) if later else own


def _merged(edges: DataFrame, kind: Kind) -> DataFrame:
    return settled(edges.groupBy("src", "dst").agg(kind.aggregated("w").alias("w")))


def _offered(own: DataFrame, offers: DataFrame, kind: Kind) -> DataFrame:
    """``own`` with the best of its values and of those offered."""
    best = offers.groupBy("name").agg(kind.aggregated("value").alias("_new"))
    return settled(own.join(best, "name", "left").select("name", kind.best(F.col("value"), F.col("_new").cast(own.schema["value"].dataType)).alias("value")))


def doubled(pointers: DataFrame, kind: Kind) -> DataFrame:
    """Pointers (name, top, w, b) followed to a top that is no pointer: a name's value is the best of ``b`` and of what the
    top hands on over ``w``. On a ring, and behind one, there is none: the top is null, and ``b`` has seen all of it.

    A pointer that is farther from its end than the steps followed so far has others before it that are nearer; so if none
    came to its end in a round, those that are left go round, and are done when their values don't change any more."""
    pointers, before = pointers.withColumn("_open", F.lit(True)), None
    while True:
        pointers = settled(_ahead(_ahead(pointers.withColumn("_was", F.col("b")), kind), kind))
        left, changed = pointers.agg(F.count_if("_open"), F.count_if(F.col("_open") & ~F.col("b").eqNullSafe(F.col("_was")))).first()
        if left and left == before and kind.cycle == "error":
            raise ValueError("the graph has a cycle")
        if not left or left == before and (kind.cycle == "mark" or not changed):
            mark = F.when(F.col("_open") & F.lit(kind.cycle == "mark"), F.lit(0).cast(pointers.schema["b"].dataType)).otherwise(F.col("b"))
            return pointers.select("name", F.when(~F.col("_open"), F.col("top")).alias("top"), "w", mark.alias("b"))
        before = left


def _ahead(pointers: DataFrame, kind: Kind) -> DataFrame:
    """Every pointer joined with the one at its top."""
    ahead = pointers.select(F.col("name").alias("top"), F.lit(True).alias("_on"), F.col("top").alias("_top"), F.col("w").alias("_w"), F.col("b").alias("_b"))
    on = F.col("_on").isNotNull()
    return pointers.join(ahead, "top", "left").select(
        "name",
        F.when(on, F.col("_top")).otherwise(F.col("top")).alias("top"),
        F.when(on, F.col("w") + F.col("_w")).otherwise(F.col("w")).alias("w"),
        F.when(on, kind.best(F.col("b"), kind.on(F.col("_b"), F.col("w")))).otherwise(F.col("b")).alias("b"),
        on.alias("_open"),
        "_was",
    )


def _travel(own: DataFrame, edges: DataFrame, into: DataFrame, kind: Kind) -> DataFrame:
    """Values over edges of which every one follows a cycle."""
    if kind.cycle == "error":
        raise ValueError("the graph has a cycle")
    if kind.cycle == "mark":
        return _offered(own, into.select("name", F.lit(0).alias("value")), kind)
    own = own.withColumn("_was", F.col("value"))
    while True:
        for _ in range(HOPS):
            offers = own.select(F.col("name").alias("src"), "value").join(edges, "src").groupBy(F.col("dst").alias("name")).agg(kind.aggregated(kind.on(F.col("value"), F.col("w"))).alias("_new"))
            own = own.join(offers, "name", "left").select("name", kind.best(F.col("value"), F.col("_new")).alias("value"), "_was")
        own = settled(own)
        if own.filter(~F.col("value").eqNullSafe(F.col("_was"))).isEmpty():
            return own.drop("_was")
        own = own.withColumn("_was", F.col("value"))


def with_ends(edges: DataFrame, *others: DataFrame) -> DataFrame:
    """(name): the ends of edges and the names of other frames."""
    names = edges.select(F.col("src").alias("name")).union(edges.select("dst"))
    for other in others:
        names = names.union(other.select("name"))
    return names.distinct()


def followed(parents: DataFrame, key: str, value: str) -> DataFrame:
    """A map of keys to values in which values that are keys are followed to the end; there are no rings."""
    while True:
        for _ in range(2):
            ahead = parents.select(F.col(key).alias(value), F.col(value).alias("_next"))
            parents = parents.select(key, value).join(ahead, value, "left").select(key, F.coalesce("_next", value).alias(value), F.col("_next").isNotNull().alias("_moved"))
        parents = settled(parents)
        if parents.filter("_moved").isEmpty():
            return parents.drop("_moved")


def connected(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, component): the least name connected in either direction. Every name that has a lesser neighbour hooks on to
    the least of them, hooks are followed to their ends, and pairs are drawn between these; local minima alone are left,
    so pairs go in a logarithm of rounds."""
    label = settled(names.select("name", F.col("name").alias("component")))
    pairs = settled(pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a <> b").distinct())
    while not pairs.isEmpty():
        hooks = followed(settled(pairs.groupBy("b").agg(F.min("a").alias("a"))), "b", "a")
        to = lambda c: hooks.select(F.col("b").alias(c), F.col("a").alias(f"_{c}"))
        label = settled(label.join(to("component"), "component", "left").select("name", F.coalesce("_component", "component").alias("component")))
        drawn = pairs.join(to("b"), "b", "left").join(to("a"), "a", "left").select(F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y"))
        pairs = settled(drawn.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return label


def strong(core: DataFrame, pairs: DataFrame) -> DataFrame:
    """(name, component): the strongly connected components of a graph, named by their least names.

    Each round colours every node with the node of least rank that reaches it, and with the one that it reaches. Where both
    agree the node is in that one's component; others can only be connected to nodes of the same two colours, so other
    edges go. Ranks are drawn anew each round, so what is left is cut in the middle, whatever its order."""
    left, pairs, found, turn = settled(core.select("name")), settled(pairs.select("src", "dst").distinct()), [], 0
    while not left.isEmpty():
        rank = F.concat(F.lpad(F.hex(F.xxhash64("name", F.lit(turn))), 16, "0"), "name")
        own = left.select("name", rank.alias("value"))
        ahead = pairs.select("src", "dst", F.lit(0).alias("w"))
        back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("w"))
        colours = resolve(own, ahead, Kind()).withColumnRenamed("value", "fore").join(resolve(own, back, Kind()).withColumnRenamed("value", "back"), "name")
        colours = settled(colours)
        found.append(colours.filter("fore = back").select("name", F.col("fore").alias("_c")))
        left = colours.filter("fore <> back")
        of = lambda c, k: left.select(F.col("name").alias(c), F.struct("fore", "back").alias(k))
        pairs = settled(pairs.join(of("src", "_s"), "src").join(of("dst", "_d"), "dst").filter("_s = _d").select("src", "dst"))
        left, turn = left.select("name"), turn + 1
    if not found:
        return core.select("name", F.col("name").alias("component"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = settled(every)
    return every.join(every.groupBy("_c").agg(F.min("name").alias("component")), "_c").select("name", "component")


def marked(edges: DataFrame) -> DataFrame:
    """(name): the nodes that a cycle reaches, those on cycles with them."""
    own = with_ends(edges).select("name", F.lit(None).cast("int").alias("value"))
    return resolve(own, edges.select("src", "dst", F.lit(0).alias("w")), Kind(cycle="mark")).filter("value is not null").select("name")


def lifted(parents: DataFrame, most: int) -> list[DataFrame]:
    """The pointers (name, up) over 1, 2, 4, … parents, up to ``most``."""
    found = [settled(parents)]
    while 1 << len(found) <= most:
        up = found[-1]
        found.append(settled(up.join(up.select(F.col("name").alias("up"), F.col("up").alias("_up")), "up").select("name", F.col("_up").alias("up"))))
    return found
