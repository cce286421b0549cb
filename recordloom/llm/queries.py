"""The queries opN_<name> and pipeline: each applies one operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm import conversation_repair, language_model, license_scans, pipeline, secret_scans, spelling_variants
from recordloom.llm.decontamination import contaminated
from recordloom.llm.fingerprints import fingerprints_and_edits
from recordloom.llm.html_extraction import extract_main_text
from recordloom.llm.language_id import identify
from recordloom.llm.near_duplicates import near_duplicates
from recordloom.llm.packing import pack, token_pieces
from recordloom.llm.quality import assess
from recordloom.llm.staging import new_path
from recordloom.llm.token_files import read_token_files, write_token_files

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return assess(documents(spark, sf_dir), labels, host="source", path=F.col("lang"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secret_scans.scan_secrets(documents(spark, sf_dir))
    return secret_scans.digest(found)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir), declared="lang", host="source")


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_token_files(documents(spark, sf_dir), path, TOKENIZER, end=1)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(documents(spark, sf_dir), TOKENIZER)
    placed = pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_and_edits(documents(spark, sf_dir))


def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scans.scan_licenses(documents(spark, sf_dir).select("doc_id", "text")).drop("text")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversation_repair.digest(conversation_repair.damage(conversations), conversations)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_quality, op2_secret_scans, op3_near_duplicates, op4_language_id, op5_lm_scoring, op6_token_files, op7_packing, op8_html_extraction, op9_decontamination, op10_fingerprints, op11_license_scans, op12_conversation_repair, op13_spelling_variants)}
QUERIES["pipeline"] = pipeline.run
ORACLE_SQL: dict[str, str] = {"op2_secret_scans": secret_scans.ORACLE_SQL, "op11_license_scans": license_scans.ORACLE_SQL}
