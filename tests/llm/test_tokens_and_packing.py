import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from recordloom.llm import packing as P
from recordloom.llm import token_files as T
from recordloom.llm.staging import new_path
from recordloom.llm.tokens import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(), st.text("ab'sT.,:!?-|<>%0 1\n\té̈ΣİßǰH̱\u0958", max_size=40)), max_size=6))
def test_words_encode_as_whole_texts(texts):
    encoder = test_words_encode_as_whole_texts.__dict__.setdefault("encoder", WordEncoder(PATH, kept=50))
    try:
        values = pa.array(texts, pa.string())
    except UnicodeEncodeError:  # lone surrogates are no text
        return
    ids, starts = encoder.encode(values, 7)
    for k, text in enumerate(texts):
        assert ids[starts[k] : starts[k + 1]].tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 7]


def test_every_code_point_before_and_after_punctuation(plain):
    """Capitals such as U+0130 and letters such as U+0958 normalise to a letter and a mark, which joins punctuation."""
    encoder = WordEncoder(PATH)
    points = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    for mark in ":>":
        texts = [f"{c}{mark}" for c in points] + [f"{mark}x{c}" for c in points]
        ids, starts = encoder.encode(pa.array(texts, pa.string()), 7)
        whole = [e.ids for e in plain.encode_batch_fast(texts, add_special_tokens=False)]
        assert np.diff(starts).tolist() == [len(w) + 1 for w in whole]
        assert ids.tolist() == [i for w in whole for i in (*w, 7)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50))
def test_byte_codes_round_trip(values):
    control, data = T.encode_values(np.array(values, np.uint32))
    assert T.decode_values(control, data, len(values)).tolist() == values
    assert len(control) == -(-len(values) // 4)


def expected(rows, plain, end):
    return {r[0]: np.array([*plain.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4") for r in rows}


def test_files_round_trip(spark, docs, rows, plain):
    path = new_path(spark, "tokens")
    T.write_token_files(docs, path, PATH, 1)
    got = {r["doc_id"]: r for r in T.read_token_files(spark, path).withColumn("crc", F.crc32("ids")).collect()}
    start = 0
    for i, ids in sorted(expected(rows, plain, 1).items()):
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["crc"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(got[i]["ids"]) == ids.tobytes()
        start += len(ids)


def test_files_of_odd_tables(spark, clash, empty, rows):
    path = new_path(spark, "tokens")
    T.write_token_files(empty, path, PATH, 1)
    assert T.read_token_files(spark, path).count() == 0
    T.write_token_files(clash.union(clash), path, PATH, 1)
    assert T.read_token_files(spark, path).count() == 2 * len(rows)


def test_rows_without_an_id_come_first(spark, plain):
    table = spark.createDataFrame([(3, "a b"), (None, "c"), (1, None)], "doc_id long, text string")
    path = new_path(spark, "tokens")
    T.write_token_files(table, path, PATH, 1)
    assert [(r["doc_id"], r["start"]) for r in T.read_token_files(spark, path).orderBy("start").collect()] == [(None, 0), (1, 2), (3, 3)]


def check_packed(packed, capacity):
    for _, bin_ in packed.groupby("sequence_id"):
        at = 0
        for offset, length in sorted(zip(bin_["offset"], bin_["length"], strict=True)):
            assert offset == at
            at += length
        assert at <= capacity


def test_packing_documents(docs, rows, plain):
    pieces = P.token_pieces(docs, PATH, 0, 64)
    packed = P.pack(pieces, 64).toPandas()
    check_packed(packed, 64)
    for i, ids in expected(rows, plain, 0).items():
        own = packed[packed["doc_id"] == i].sort_values("piece")
        assert b"".join(map(bytes, own["ids"])) == ids.tobytes()
        assert own["start"].tolist() == list(range(0, len(ids), 64)) and own["piece"].tolist() == list(range(-(-len(ids) // 64)))
        assert (own["length"][:-1] == 64).all()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_combinations_place_everything(counts):
    left = dict(counts)
    for times, bins in P.combinations(counts, 40):
        assert sum(k * n for k, n in times) <= 40
        for k, n in times:
            left[k] -= n * bins
    assert all(v == 0 for v in left.values())


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 3), max_size=5), st.integers(1, 60))
def test_fullest_is_the_best_subset(available, room):
    sums = {0}
    for k, n in available.items():
        sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= room}
    got = P.fullest(available, room)
    assert sum(k * n for k, n in got) == max(sums) and all(n <= available[k] for k, n in got)


def test_equal_lengths_and_odd_tables(spark, empty):
    items = spark.createDataFrame([(k, 30, "x") for k in range(500)] + [(k, 70, "y") for k in range(500, 900)], "doc_id long, length long, nth string").repartition(5)
    packed = P.pack(items, 100).toPandas()
    check_packed(packed, 100)
    assert packed["sequence_id"].nunique() == 400 + -(-100 // 3)
    assert P.pack(P.token_pieces(empty, PATH)).count() == 0
    with pytest.raises(Exception, match="length out of range"):
        P.pack(items, 50).count()
