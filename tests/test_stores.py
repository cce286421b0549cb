import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import embedded_sql as Q
from recordloom.operators import keyed as K
from recordloom.sources.sorted_files import SortedStore
from recordloom.sources.versions import Conflict, VersionedStore, committed_groups


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    keys = [3 * k for k in range(1500)] + [300] * 700 + [None] * 5
    rng.shuffle(keys)
    return [(k, n, f"v{n}") for n, k in enumerate(keys)]


@pytest.fixture(scope="module")
def store(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "k long, n int, v string").repartition(5)
    return SortedStore.write(df, str(tmp_path_factory.mktemp("store")), ["k"], ["n"], files=40)


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def test_point_reads_open_few_files(store, rows):
    assert len(store.files) > 30 and store.total == len(rows)
    for key in (0, 3, 4, 2997, 4497, 9999, None):
        got = store.read(key)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == [r for r in rows if r[0] == key]
        assert len(store.holding([key])) <= 1
    assert len(store.holding([300])) > 5  # a hot key is over several files
    assert store.read(300).count() == 701
    assert len(store.read(2997).inputFiles()) == 1


def test_read_keys(spark, store, rows):
    got = store.read_keys(spark.createDataFrame([(9,), (10,), (300,)], "k long"))
    assert sorted((r["k"], r["file_status"]) for r in got.select("k", "file_status").distinct().collect()) == [(9, "00"), (10, "23"), (300, "00")]
    many = spark.range(20_000).select(F.col("id").alias("k"))
    assert store.read_keys(many).filter("file_status = '00'").count() == 2200


def test_browsing(store, rows):
    keys = [r[0] for r in order(rows)]
    for relation, test in ((">=", lambda k: k >= 301), (">", lambda k: k > 300), ("<", lambda k: k < 9), ("<=", lambda k: k <= 9), ("=", lambda k: k == 12)):
        value = {">=": 301, ">": 300, "<": 9, "<=": 9, "=": 12}[relation]
        found, status = store.start(relation, value)
        assert status == "00" and [r["k"] for r in found.collect()] == [k for k in keys if k is not None and test(k)]
    assert [store.start(r, v)[1] for r, v in (("=", 13), (">", 4497), ("<", 0), (">=", 4497))] == ["23", "23", "23", "00"]
    assert [r["k"] for r in store.read_next(10, 299).collect()] == [k for k in keys if k is not None and k > 299][:10]
    assert len(store.read_next(5, 3000).inputFiles()) <= 2
    assert [r["k"] for r in store.read_previous(4, 12).collect()] == [9, 6, 3, 0]
    assert [r["k"] for r in store.read_next(7).collect()] == keys[:7]


def test_positions(spark, store, rows):
    want = order(rows)
    for at in (1, 2, 777, len(rows), -1, -len(rows)):
        assert [tuple(r) for r in store.fetch(at).collect()] == [want[at - 1 if at > 0 else at]]
    assert store.fetch(0).count() == store.fetch(len(rows) + 1).count() == store.fetch(-len(rows) - 1).count() == 0
    assert [(r["rank"], r["n"]) for r in store.slice(500, 900).orderBy("rank").collect()] == [(k, want[k - 1][1]) for k in range(500, 901)]
    asked = spark.createDataFrame([(a, p) for a, p in enumerate([5, -5, 0, 10_000, None])], "a int, p long")
    got = {r["a"]: r["n"] for r in store.fetch_many(asked, "p").collect()}
    assert got == {0: want[4][1], 1: want[-5][1], 2: None, 3: None, 4: None}


def test_empty_store(spark, tmp_path):
    empty = SortedStore.write(spark.createDataFrame([], "k long, n int"), str(tmp_path / "e"), ["k"])
    assert empty.total == 0 and empty.read(1).count() == 0 and empty.start(">", 0)[1] == "23" and empty.fetch(1).count() == 0


def test_scroll_cursor(spark, rows):
    """A thousand positioned fetches: one sort, and a read for each page that isn't held."""
    want = [r[1] for r in order(rows)]
    cursor = Q.ScrollCursor(spark.createDataFrame(rows, "k long, n int, v string"), ["k", "n"], page=400)
    assert cursor.fetch().sqlcode == -501 and cursor.close().sqlcode == -501
    cursor.open()
    rng, at, total = random.Random(2), 0, len(want)
    for _ in range(1000):
        move = rng.choice(["next", "next", "prior", "relative", "absolute", "first", "last"] if rng.random() < 0.05 else ["next", "prior", "relative"])
        step = rng.randint(-8, 8)
        got = {"next": cursor.fetch, "prior": cursor.prior, "first": cursor.first, "last": cursor.last, "relative": lambda s=step: cursor.relative(s), "absolute": lambda s=step: cursor.absolute(s)}[move]()
        goal = {"next": at + 1, "prior": at - 1, "first": 1, "last": total, "relative": at + step, "absolute": step if step >= 0 else total + 1 + step}[move]
        at = max(0, min(goal, total + 1))
        if at == goal and 1 <= at <= total:
            assert got.sqlcode == 0 and got.value["n"] == want[at - 1]
        else:
            assert got.sqlcode == 100
    assert cursor.reads < 120
    cursor.absolute(3)
    assert cursor.where_current(["k", "n"]) is not None and cursor.close().is_success


def test_versions_and_conflicts(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    tx = store.begin()
    tx.create("t", spark.range(100).select("id", (F.col("id") % 7).alias("g")).repartitionByRange(5, "id"))
    assert store.versions() == [] and tx.commit() == 1
    first, second = store.begin(), store.begin()
    before = set(first.manifest["tables"]["t"]["files"])
    assert first.update("t", {"g": F.lit(9)}, F.col("id") < 10) == 10
    assert len(before & set(first.manifest["tables"]["t"]["files"])) == 4  # only the file with these rows is new
    assert first.delete("t", F.col("id") == 99) == 1 and first.delete("t", F.col("id") > 1000) == 0
    assert store.read("t").filter("g = 9").count() == 0
    first.commit()
    second.insert("t", spark.range(1000, 1003).select("id", F.lit(0).cast("long").alias("g")))
    with pytest.raises(Conflict):
        second.commit()
    again = VersionedStore(spark, str(tmp_path / "s"))
    assert again.versions() == [1, 2] and again.read("t").count() == 99 and again.read("t", 1).count() == 100
    assert again.read("t").filter("g = 9").count() == 10


def test_savepoints_beyond_the_session(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "s"))
    tx = store.begin()
    tx.create("t", spark.range(5))
    kept = tx.savepoint("a")
    tx.delete("t", F.col("id") > 0)
    assert tx["t"].count() == 1
    tx.rollback_to(kept)
    assert tx["t"].count() == 5
    tx.delete("t", F.col("id") > 2)
    tx.rollback()
    assert "t" not in tx.manifest["tables"]
    other = VersionedStore(spark, str(tmp_path / "s")).resume(kept)
    assert other.insert("t", spark.range(5, 7)) == 2 and other.commit() == 1
    assert sorted(r["id"] for r in store.read("t").collect()) == list(range(7))


def test_a_lost_run_goes_on_after_its_last_commit(spark, tmp_path):
    source = SortedStore.write(spark.range(1050), str(tmp_path / "source"), ["id"])
    store = VersionedStore(spark, str(tmp_path / "s"))
    run = committed_groups(store, "t", source, 100, 2)
    assert next(run) == 2 and next(run) == 4
    run.close()
    lost = store.begin()  # a commit's files without its manifest: they are in no version
    lost.insert("t", spark.range(5).select("id", F.lit(99).cast("long").alias("commit_group")))
    assert store.read("t").count() == 400 and store.manifest()["positions"] == {"t": 4}
    assert list(committed_groups(store, "t", source, 100, 4)) == [8, 11]
    assert {(r["id"], r["commit_group"]) for r in store.read("t").collect()} == {(k, k // 100) for k in range(1050)}
    assert list(committed_groups(store, "t", source, 100)) == []


def test_many_commits_take_few_jobs(spark, tmp_path, monkeypatch):
    """Two hundred commits: a logarithm of jobs, versions of one size, and each commit's rows in its version."""
    source, path, jobs = SortedStore.write(spark.range(4010), str(tmp_path / "source"), ["id"]), str(tmp_path / "s"), []
    write = VersionedStore.write_files
    monkeypatch.setattr(VersionedStore, "write_files", lambda self, df: jobs.append(1) or write(self, df))
    store = VersionedStore(spark, path)
    assert list(committed_groups(store, "t", source, 10, 2)) == [*range(2, 401, 2), 401]
    assert len(jobs) < 12 and store.versions() == list(range(1, 202))
    assert {(r["id"], r["commit_group"]) for r in store.read("t").collect()} == {(k, k // 10) for k in range(4010)}
    for version in (1, 2, 77, 200):
        assert sorted(r["id"] for r in VersionedStore(spark, path).read("t", version).collect()) == list(range(20 * version))
    assert max(len(str(store.manifest(v))) for v in (150, 201)) < 2000


def test_a_store_is_changed_between_the_commits_of_a_run(spark, tmp_path):
    source = SortedStore.write(spark.range(400), str(tmp_path / "source"), ["id"])
    store = VersionedStore(spark, str(tmp_path / "s"))
    run = committed_groups(store, "t", source, 10, 1)
    assert [next(run) for _ in range(5)] == [1, 2, 3, 4, 5]  # the fifth is within a list of files
    tx = store.begin()
    tx.create("other", spark.range(3))
    tx.commit()
    assert next(run) == 6 and store.read("other").count() == 3
    tx = store.begin()
    assert tx.update("t", {"commit_group": F.lit(-1)}, F.col("id") < 15) == 15 and tx.delete("t", F.col("id") == 59) == 1
    tx.commit()
    assert next(run) == 7 and store.read("t").count() == 69
    assert list(run)[-1] == 40
    found = {r["id"]: r["commit_group"] for r in store.read("t").collect()}
    assert found == {k: -1 if k < 15 else k // 10 for k in range(400) if k != 59} and store.read("t").count() == 399
    run, twin = (committed_groups(store, "u", source, 10, 1) for _ in range(2))
    assert next(run) == 1 and next(twin) == 2
    with pytest.raises(Conflict):
        next(run)


def test_relative_file(spark, tmp_path):
    file = K.RelativeFile(spark, str(tmp_path / "r"), 4)
    slots = [1, 2, 5, 40_000, 70_000]
    file.load(spark.createDataFrame([(s, str(s).encode()) for s in slots], "record_number long, record binary"))
    assert [(r["record_number"], bytes(r["record"]).strip()) for r in file.read().orderBy("record_number").collect()] == [(s, str(s)[:4].encode()) for s in slots]
    judged = file.delete(spark.createDataFrame([(2,), (3,), (40_000,), (99_999,)], "record_number long"))
    assert {(r["record_number"], r["file_status"]) for r in judged.collect()} == {(2, "00"), (3, "23"), (40_000, "00"), (99_999, "23")}
    assert sorted(r["record_number"] for r in file.read().collect()) == [1, 5, 70_000]
    again = file.delete(spark.createDataFrame([(2,), (1,)], "record_number long"))
    assert {(r["record_number"], r["file_status"]) for r in again.collect()} == {(2, "23"), (1, "00")}
    assert sorted(r["record_number"] for r in file.read().collect()) == [5, 70_000]
