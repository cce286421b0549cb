import random
from collections import deque

import pytest

from recordloom.operators import graph as G
from recordloom.operators import paths
from recordloom.plans.catalog import QUERIES


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, "CALL") for a, b in pairs], "src string, dst string, type string")


def names(spark, *xs):
    return spark.createDataFrame([(x,) for x in xs], "name string")


def random_graph(seed, n, m):
    rng = random.Random(seed)
    node = lambda k: f"n{k:03d}"
    return list({(node(rng.randrange(n)), node(rng.randrange(n))) for _ in range(m)})


def successors(pairs):
    out = {}
    for a, b in sorted(pairs):
        out.setdefault(a, []).append(b)
    return out


def bfs(pairs, roots):
    to, level, queue = successors(pairs), {r: 0 for r in roots}, deque(roots)
    while queue:
        x = queue.popleft()
        for y in to.get(x, ()):
            if y not in level:
                level[y] = level[x] + 1
                queue.append(y)
    return level


def dfs(pairs, roots):
    to, seen = successors(pairs), []

    def visit(x):
        seen.append(x)
        for y in to.get(x, ()):
            if y not in seen:
                visit(y)

    for r in sorted(roots):
        if r not in seen:
            visit(r)
    return seen


GRAPHS = [(2, 16, 22)]


@pytest.mark.parametrize("seed,n,m", GRAPHS)
def test_random_graphs(spark, seed, n, m):
    pairs = random_graph(seed, n, m)
    edges, every = frame(spark, pairs), sorted({x for p in pairs for x in p})
    roots = [every[0], every[len(every) // 2]]
    assert {r["name"]: r["level"] for r in G.levels(edges, names(spark, *roots)).collect()} == bfs(pairs, roots)
    reach = {x: set(bfs(pairs, [x])) for x in every}
    strong = {x: min(y for y in reach[x] if x in reach[y]) for x in every}
    assert {r["name"]: r["component"] for r in G.strong_components(names(spark, *every), edges).collect()} == strong
    ring = {x for x in every if any(x in reach[y] for y in successors(pairs).get(x, ()))}
    order = [r["name"] for r in G.preorder(edges, names(spark, *roots)).orderBy("position").collect()]
    assert order == dfs(pairs, roots)
    cycles = [r["cycle"] for r in G.back_edge_cycles(edges).collect()]
    assert all((a, b) in set(pairs) for c in cycles for a, b in zip(c, c[1:] + c[:1], strict=True)) and all(len(set(c)) == len(c) for c in cycles)
    assert {strong[c[0]] for c in cycles} == {strong[x] for x in ring} and len(cycles) <= len(pairs)


def test_acyclic_levels(spark):
    pairs = [(a, b) for a, b in random_graph(9, 40, 90) if a < b]
    longest = {}
    for x in sorted({x for p in pairs for x in p}):
        longest[x] = max((longest[a] + 1 for a, b in pairs if b == x), default=0)
    edges = frame(spark, pairs)
    assert {r["name"]: r["level"] for r in G.topological_levels(names(spark), edges).collect()} == longest
    for more in ([("n039", "n000")], [("z", "z")], [("y", "z"), ("z", "y")]):
        with pytest.raises(ValueError, match="cycle"):
            G.topological_levels(names(spark), frame(spark, pairs + more + [(a, b) for a, b in zip(sorted(longest), sorted(longest)[1:], strict=False)]))


@pytest.fixture
def writes(monkeypatch):
    """How many frames were written."""
    count = []
    for module in (paths, G):
        monkeypatch.setattr(module, "settled", lambda df, f=module.settled: count.append(1) or f(df))
    return count


def test_a_long_path_ends_in_few_rounds(spark, writes):
    chain = spark.range(12_000).selectExpr("concat('n', lpad(id, 6, '0')) as src", "concat('n', lpad(id + 1, 6, '0')) as dst", "'CALL' as type")
    found = G.levels(chain, names(spark, "n000000"))
    assert found.count() == 12_001 and found.agg({"level": "max"}).first()[0] == 12_000 and len(writes) < 40
    assert G.topological_levels(names(spark), chain).agg({"level": "max"}).first()[0] == 12_000
    assert [r["component"] for r in G.weak_components(names(spark, "n000007", "n000003"), chain).select("component").distinct().collect()] == ["n000003"]


def test_a_chain_before_a_ring(spark, writes):
    """A chain of 20,000 nodes that leads into a ring of 50, and a complete graph of 20 nodes."""
    chain = spark.range(20_000).selectExpr("concat('c', lpad(id, 6, '0')) as src", "if(id = 19999, 'r00', concat('c', lpad(id + 1, 6, '0'))) as dst")
    ring = spark.range(50).selectExpr("concat('r', lpad(id, 2, '0')) as src", "concat('r', lpad((id + 1) % 50, 2, '0')) as dst")
    found = G.strong_components(names(spark), chain.union(ring))
    assert len(writes) < 80
    assert found.filter("component <> name").count() == 49 and found.count() == 20_050
    full = [(f"k{a:02d}", f"k{b:02d}") for a in range(20) for b in range(20) if a != b]
    cycles = [r["cycle"] for r in G.back_edge_cycles(chain.union(ring).union(frame(spark, full).select("src", "dst"))).collect()]
    assert sorted(map(len, cycles)) == [2] * 19 + [50]


def test_components_are_found_once_and_followed_back_among_what_cycles_reach(spark, tmp_path, monkeypatch):
    sizes, strong = [], []
    monkeypatch.setattr(paths, "marked", lambda df, f=paths.marked: sizes.append(df.count()) or f(df))
    monkeypatch.setattr(paths, "strong", lambda *a, f=paths.strong: strong.append(1) or f(*a))
    spark.range(120).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    to = {k: (k * k + 1) % 120 for k in range(120)}
    want, on = {}, lambda k, n=0: to[k] if n == 0 else on(to[k], n - 1)
    for k in range(120):
        ring = {on(k, n) for n in range(120)}
        if k in ring:
            want[f"P{min(ring):09d}"] = len(ring)
    got = {r["component"]: r["nodes"] for r in QUERIES["graph_back_edges"](spark, str(tmp_path)).collect()}
    assert got == want and len(strong) == 1
    assert sizes == [120, sum(want.values())]


def test_empty_graphs(spark):
    none = frame(spark, [])
    assert G.strong_components(names(spark, "a"), none).collect()[0]["component"] == "a"
    assert G.back_edge_cycles(none).count() == G.on_cycles(none).count() == 0
    assert [r["name"] for r in G.preorder(none, names(spark, "b", "a")).orderBy("position").collect()] == ["a", "b"]
    assert G.topological_levels(names(spark, "a"), none).count() == 1
