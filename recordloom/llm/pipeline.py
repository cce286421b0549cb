"""A corpus pipeline of five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.

1. language_id drops documents whose language can't be told;
2. near_duplicates keeps one document of each group: the least doc_id, a row without one only if no other is there;
3. decontamination drops documents that hold a benchmark item;
4. secret_scans replaces every secret by a mark and counts the characters anew;
5. packing cuts token sequences of at most 2048 from what is left and fills them.

Stages 1 and 2 decide by row, not by doc_id: a row goes by a 64-bit hash of its doc_id and text, so rows that have no
doc_id, or share one with another text, are documents of their own, and only equal rows are one. No stage samples or
caps rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import secret_scans
from recordloom.llm.decontamination import decontaminate
from recordloom.llm.language_id import identify
from recordloom.llm.near_duplicates import near_duplicates as find_near_duplicates
from recordloom.llm.packing import pack, token_pieces
from recordloom.llm.staging import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs with _key, the same with the key as doc_id)."""
    rows = docs.select(COLUMNS).withColumn("_key", F.xxhash64("doc_id", "text"))
    return rows, rows.withColumn("doc_id", F.col("_key"))


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose _key is among ``keys``, with it."""
    return rows.join(keys.select("_key").distinct(), "_key", "left_semi")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, keyed = _keyed(docs)
    decided = identify(keyed, declared="lang", host="source").filter("kept")
    return _only(rows, decided.select(F.col("doc_id").alias("_key"))).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, keyed = _keyed(docs)
    found = find_near_duplicates(keyed).select(F.col("doc_id").alias("_key"), "component_id")
    ids = rows.select("_key", "doc_id").distinct().join(found.distinct(), "_key")
    first = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_key")).alias("first")).select("first._key")
    one = _only(rows, first).groupBy("_key", "doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))  # of equal rows
    return one.select("doc_id", "text", "rest.*").select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found, _ = secret_scans.scan_secrets(docs.select(COLUMNS))
    return secret_scans.redact(found).withColumn("n_chars", F.char_length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scans", secrets), ("packing", packing)]

#: Near duplicates, banded alignment and subword tokens are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of ``sf_dir``, each to the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), name)
    return docs
