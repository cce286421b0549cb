import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.plans import catalog
from recordloom.sources import files, records
from recordloom.sources.staged import running_total


def held(df):
    return [bytes(r["record"]) for r in df.orderBy("position").collect()]


def numbers(df):
    return sorted(r["position"] for r in df.select("position").collect())


def test_many_files_and_ragged_tails_in_splits(spark, tmp_path, monkeypatch):
    """Files of several splits beside small ones, each with a ragged tail: the splits are planned in the reader's process,
    so the limit is lowered through the reader itself."""
    monkeypatch.setattr(records, "SPLIT", 100)
    monkeypatch.setattr(records, "STEP", 30)
    contents = {"a": b"".join(b"a%07d" % k for k in range(10)) + b"xy", "b": b"".join(b"b%07d" % k for k in range(200)), "c": b"z", "d": b"", "_hidden": b"12345678"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for ragged in ("pad", "drop"):
        reader = records.FixedReader({"path": str(tmp_path), "recordlength": "8", "ragged": ragged})
        parts = reader.partitions()
        assert len(parts) > 10 and all(sum(p[2] - p[1] for p in part.pieces) <= 100 for part in parts)
        got = [x for part in parts for batch in reader.read(part) for x in zip(batch["position"].to_pylist(), batch["record"].to_pylist(), strict=True)]
        want = []
        for name in "abcd":
            data = contents[name]
            whole = [data[k : k + 8] for k in range(0, len(data), 8)]
            want += [w.ljust(8) for w in whole if ragged == "pad" or len(w) == 8]
        assert got == list(enumerate(want))
    frame = files.read_fixed(spark, str(tmp_path), 8)
    assert len(held(frame)) == 212 and numbers(frame) == list(range(212))
    with pytest.raises(Exception, match="39"):
        files.read_fixed(spark, str(tmp_path), 8, ragged="fail").count()


def test_no_rdd_in_the_plan(spark, tmp_path):
    (tmp_path / "f").write_bytes(b"12345678" * 3)
    plan = files.read_fixed(spark, str(tmp_path), 8)._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "ExistingRDD" not in plan


def test_paths(spark, tmp_path):
    for name in ("p1", "p2", "q1"):
        (tmp_path / name).write_bytes(name.encode() * 2)
    assert held(files.read_fixed(spark, f"{tmp_path}/p*", 2)) == [b"p1", b"p1", b"p2", b"p2"]
    assert held(files.read_fixed(spark, f"file://{tmp_path}/q1", 2)) == [b"q1", b"q1"]
    for path in ("nowhere://host/x", "unknown://x"):
        with pytest.raises(ValueError, match="30"):
            records.system_of(path)
    rows = spark.createDataFrame([(b"a",)], "record binary")
    with pytest.raises(Exception, match="30"):
        files.write_fixed(rows, "nowhere://host/x", 4)
    with pytest.raises(Exception, match="35"):
        files.read_fixed(spark, f"{tmp_path}/none", 4).count()


def brute_chain(data):
    """(records, torn place or None), one after the other."""
    at, out = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return out, at
        size, zero = struct.unpack_from(">HH", data, at)
        if zero or size < 4 or at + size > len(data):
            return out, at
        out.append(data[at + 4 : at + size])
        at += size
    return out, None


def framed(parts):
    return b"".join(struct.pack(">HH", len(p) + 4, 0) + p for p in parts)


def sample(seed, n, longest=3000):
    rng = random.Random(seed)
    kinds = (lambda: bytes(rng.randrange(3) for _ in range(rng.randint(0, 40))), lambda: b"\x00\x08\x00\x00abcd" * rng.randint(0, 20), lambda: rng.randbytes(rng.randint(0, longest)), lambda: b"", lambda: b"\x00" * rng.randint(0, 50))
    return [rng.choice(kinds)() for _ in range(n)]


def test_chunk_maps_against_chains():
    """Every entry of a chunk leads where walking leads, whatever lies in the records."""
    rng = random.Random(1)
    for n in range(30):
        data = framed(sample(n, 40, 200)) + rng.choice([b"", b"\x00\x09\x00\x00ab", b"\x00", b"\x00\x03\x00\x00", b"abcdef"])
        size = rng.randint(1, len(data))
        raw = np.frombuffer(data, np.uint8)
        enter, leave, count, whole = records.chunk_map(raw[: size + 3], size, len(data))
        for e, x, c, w in zip(enter, leave, count, whole, strict=True):
            at, k, broken = int(e), 0, False
            while at < size:
                if at + 4 > len(data) or data[at + 2] or data[at + 3] or data[at] * 256 + data[at + 1] < 4 or at + data[at] * 256 + data[at + 1] > len(data):
                    broken = True
                    break
                at, k = at + data[at] * 256 + data[at + 1], k + 1
            assert (x, c, w) == (-1 if broken else at, k, at), (n, e)


def test_length_prefixed_in_chunks(spark, tmp_path):
    want = {}
    for name, n in (("a", 900), ("b", 3), ("c", 0), ("d", 1500)):
        want[name] = sample(name, n)
        (tmp_path / name).write_bytes(framed(want[name]))
    frame = files.read_variable(spark, str(tmp_path), chunk=70_000)
    assert records.chunks_of(spark, str(tmp_path), 70_000).count() > 12
    assert held(frame) == want["a"] + want["b"] + want["d"]
    assert numbers(frame) == list(range(2403))
    assert {r["path"][-1]: (r["records"], r["file_status"]) for r in files.variable_status(spark, str(tmp_path), 70_000).collect()} == {"a": (900, "00"), "b": (3, "00"), "c": (0, "00"), "d": (1500, "00")}


@pytest.mark.parametrize("block", [0, 8000])
@pytest.mark.parametrize("want", [sample(3, 50), []])
def test_empty_files_before_others(spark, tmp_path, block, want):
    """A task without rows writes an empty file, be it the first or each one."""
    path = str(tmp_path / "v")
    files.write_variable(spark.createDataFrame([(p,) for p in want], "record binary").coalesce(1), path, block=block)
    (tmp_path / "v" / "a").touch()
    assert records.list_files(path)[0] == (f"{path}/a", 0)
    frame = files.read_variable(spark, path, blocked=bool(block))
    assert held(frame) == want and numbers(frame) == list(range(len(want)))
    assert {r["file_status"] for r in files.variable_status(spark, path).collect()} == {"00"}


def test_rdw_scan_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "c_custkey long, c_name string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    assert catalog.QUERIES["rdw_scan"](spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("tail,status", [(b"\x00\x20\x00\x00short", "04"), (b"\x00\x05", "04"), (b"\x00\x02\x00\x00", "39"), (b"garbage, no descriptor", "39")])
def test_torn_tails(spark, tmp_path, tail, status):
    parts = sample(8, 400)
    (tmp_path / "t").write_bytes(framed(parts) + tail + (framed([b"after"]) if status == "39" else b""))
    with pytest.raises(ValueError, match="39"):
        files.read_variable(spark, str(tmp_path), chunk=70_000)
    assert held(files.read_variable(spark, str(tmp_path), torn="drop", chunk=70_000)) == parts
    assert [(r["records"], r["file_status"]) for r in files.variable_status(spark, str(tmp_path), 70_000).collect()] == [(400, status)]


def test_blocks(spark, tmp_path):
    parts = sample(5, 1200, 2000)
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(parts)], "k int, record binary").repartitionByRange(3, "k").sortWithinPartitions("k")
    files.write_variable(rows, str(tmp_path / "v"), block=8000)
    data = [(tmp_path / "v" / n).read_bytes() for n in sorted(p.name for p in (tmp_path / "v").iterdir() if p.name.startswith("part-"))]
    blocks = [b for d in data for b in brute_chain(d)[0]]
    assert all(len(b) + 4 <= 8000 for b in blocks) and len(blocks) < 1000
    assert [r for b in blocks for r in brute_chain(b)[0]] == parts
    frame = files.read_variable(spark, str(tmp_path / "v"), blocked=True, chunk=70_000)
    assert held(frame) == parts and numbers(frame) == list(range(1200))
    with pytest.raises(Exception, match="34"):
        files.write_variable(rows, str(tmp_path / "w"), block=1000)


def test_writers_against_plain_python():
    rng = random.Random(2)
    for _ in range(20):
        parts = [rng.randbytes(rng.randint(0, 9)) for _ in range(rng.randint(0, 12))]
        array = pa.array([b"skipped", *parts], pa.binary())[1:]
        offsets = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
        data = np.frombuffer(array.buffers()[2], np.uint8)
        assert records.padded(data, offsets, 5, b"*").tobytes() == b"".join(p[:5].ljust(5, b"*") for p in parts)
        assert records.prefixed(data, offsets).tobytes() == framed(parts)


def test_modes_and_statuses(spark, tmp_path):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "record binary").coalesce(1)
    f = files.RecordFile(spark, str(tmp_path / "m"), 3)
    assert f.open("INPUT") == "35" and f.open("I-O") == "35" and f.read() is None and f.status == "47"
    assert f.open("EXTEND") == "00" and f.write(rows(b"one")) == "00" and f.open("INPUT") == "41" and f.close() == "00" and f.close() == "42"
    assert f.open("OUTPUT") == "00" and f.write(rows(b"a", b"b")) == "00" and f.write(rows(b"c")) == "00" and f.read() is None and f.status == "47"
    f.close()
    assert f.open("INPUT") == "00" and held(f.read()) == [b"a  ", b"b  ", b"c  "]
    assert f.write(rows(b"x")) == "48" and f.rewrite(rows(b"x")) is None and f.status == "49"
    f.close()
    f.open("I-O")
    judged = f.rewrite(spark.createDataFrame([(1, b"B"), (9, b"?")], "position long, record binary"))
    assert {(r["position"], r["file_status"]) for r in judged.collect()} == {(1, "00"), (9, "23")}
    assert held(f.read()) == [b"a  ", b"B  ", b"c  "]
    assert files.RecordFile(spark, "nowhere://x/y", 3).open("OUTPUT") == "30"


def test_running_total(spark):
    df = spark.createDataFrame([(k % 2 if k % 5 else None, k * 37 % 500, k % 7 if k % 3 else None) for k in range(500)], "g int, v int, x int")
    got = running_total(df, ["v"], "x", "t", ["g"]).collect()
    for g in (0, 1, None):
        total = None
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["v"]):
            total = total if r["x"] is None else r["x"] + (total or 0)
            assert r["t"] == total
    one = running_total(df.filter("x is not null"), [F.desc("v")], "x", "t").agg(F.max("t"), F.sum("x")).first()
    assert one[0] == one[1]
