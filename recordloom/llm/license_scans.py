"""License scans by diagonal voting, in DataFrame functions only.

Templates are short phrases and passages of license texts, as words. All rolling word k-grams of a text are hashed and
joined with the grams of the templates; every hit whose words agree votes for the diagonal (place in the text minus
place in the template) on which the template would lie. Votes are added up by text, template and diagonal, neighbouring
diagonals are merged, as words that were put in or left out shift the rest of a passage, and the span is verified: a
phrase must stand whole, and of a passage the grams found must cover COVERED of its words at least.

The templates are a parameter of fixed size, so their grams are broadcast; texts are never shuffled, only votes are.
Exact copies share their votes, which are keyed by the SHA-256 of the text.

Nulls and empty texts have no words, no labels and score 0; long texts are read whole; rows that repeat a text or an id
get a result each; ties don't arise, as labels are sets and places are counted; an empty table gives none. Columns of
the documents named as a result column (n_words, n_base and so on) or _text_key are replaced, others are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.llm.staging import look_up, stage


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        """Words of a gram: phrases are matched by pairs, passages by longer grams."""
        return LONG if len(self.words) >= PASSAGE else SHORT


#: Words of a gram of phrases and of passages, and the words from which on a template is a passage.
SHORT, LONG, PASSAGE = 2, 5, 12
#: Diagonals on either side that count with one, and the share of a passage that must be covered.
SHIFT, COVERED = 8, 0.6
WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The phrases of the contract, further names of licenses, and public license texts.
TEMPLATES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("bsd", "bsd license"),
    Template("isc", "isc license"),
    Template("cc-by", "creative commons attribution"),
    Template("cc-by", "cc by 4 0"),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    Template(
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    Template(
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    ),
)


def words_of(text: Column) -> Column:
    """The words of a text with A to Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")  # several times as fast as gathering matches of WORD


def _hash(words: Column, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def template_table(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, label, base, k, passage, parts), a row for each template."""
    rows = [F.struct(F.lit(n).alias("template"), F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.k).alias("k"), F.lit(t.k == LONG).alias("passage"), F.lit(t.text).alias("words")) for n, t in enumerate(templates)]
    return spark.range(1).select(F.inline(F.array(*rows))).withColumn("parts", F.split("words", " ")).drop("words")


def template_grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """(template, tk, length, at, gram, h): every gram of every template with its hash."""
    table = template_table(spark, templates).select("template", F.col("k").alias("tk"), F.size("parts").alias("length"), "parts", F.explode(F.sequence(F.lit(0), F.size("parts") - F.col("k"))).alias("at"))
    h = F.when(F.col("tk") == SHORT, _hash(F.col("parts"), F.col("at"), SHORT)).otherwise(_hash(F.col("parts"), F.col("at"), LONG))
    return table.select("template", "tk", "length", "at", F.slice("parts", F.col("at") + 1, F.col("tk")).alias("gram"), h.alias("h"))


def votes(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(_text_key, template, length, k, diagonal, ats): for each text and diagonal the template's places found there."""
    grams = F.broadcast(template_grams(docs.sparkSession, templates))  # a fixed parameter
    texts = docs.select(_text_key(), words_of(F.col("text")).alias("words"))
    # a number for each place and gram size: even ones are pairs, odd ones the longer grams
    placed = texts.select("_text_key", "words", F.explode(F.when(F.size("words") >= SHORT, F.sequence(F.lit(0), 2 * F.size("words") - 1))).alias("_n"))
    at, short = F.shiftright("_n", 1), F.col("_n") % 2 == 0
    fits = at + F.when(short, SHORT).otherwise(LONG) <= F.size("words")
    hashed = placed.filter(fits).select("_text_key", "words", at.alias("place"), F.when(short, _hash(F.col("words"), at, SHORT)).otherwise(_hash(F.col("words"), at, LONG)).alias("h"))
    agree = F.slice("words", F.col("place") + 1, F.col("tk")) == F.col("gram")  # hashes may collide
    hits = hashed.join(grams, "h").filter(agree).select("_text_key", "template", "length", F.col("tk").alias("k"), (F.col("place") - F.col("at")).alias("diagonal"), "at")
    return hits.groupBy("_text_key", "template", "length", "k", "diagonal").agg(F.collect_set("at").alias("ats"))


def spans(found: DataFrame, shift: int = SHIFT) -> DataFrame:
    """(_text_key, template, start, covered): for each diagonal the share of the template's words that the grams on it
    and, for passages, on the ``shift`` diagonals on either side cover."""
    near = Window.partitionBy("_text_key", "template").orderBy("diagonal").rangeBetween(-shift, shift)
    merged = F.when(F.col("k") == LONG, F.flatten(F.collect_list("ats").over(near))).otherwise(F.col("ats"))
    words = F.array_distinct(F.flatten(F.transform("merged", lambda a: F.sequence(a, a + F.col("k") - 1))))
    return found.withColumn("merged", merged).select("_text_key", "template", F.col("diagonal").alias("start"), (F.size(words) / F.col("length")).alias("covered"))


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``docs`` (doc_id, text) with n_words, n_base, first_word, last_word, base_labels, labels and score: the number of
    words; places of base phrases, and where the first and last start (null without any); the labels of base phrases
    and of all templates found; and the greatest share of a template that was found in one place."""
    results = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    docs = docs.drop("_text_key", "_salt", *results)
    facts = F.broadcast(template_table(docs.sparkSession, templates).select("template", "label", "base", "passage"))  # a fixed parameter
    verified = spans(votes(docs, templates)).join(facts, "template").filter((F.col("covered") == 1) | F.col("passage"))
    whole = F.col("covered") >= F.when(F.col("passage"), COVERED).otherwise(1.0)
    base = F.when(F.col("base"), F.col("start"))
    per_text = verified.groupBy("_text_key").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, F.col("label")))), ",").alias("labels"),
        F.max("covered").alias("score"),
    )
    counted = docs.withColumns({"_text_key": _text_key(), "n_words": F.size(words_of(F.col("text"))).cast("long")})
    joined = look_up(counted, per_text, ["_text_key"], F.xxhash64("doc_id", "n_words"))
    nothing = {"n_base": F.lit(0).cast("long"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0)}
    return joined.withColumns({c: F.coalesce(c, v) for c, v in nothing.items()}).select(*docs.columns, *results)


def license_spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, label, start, covered): the places of phrases, and of each passage found its best place in the text."""
    docs = docs.drop("_text_key", "_salt")
    facts = F.broadcast(template_table(docs.sparkSession, templates).select("template", "label", "passage"))  # a fixed parameter
    found = spans(votes(docs, templates)).join(facts, "template").filter(F.col("covered") >= F.when(F.col("passage"), COVERED).otherwise(1.0))
    best = Window.partitionBy("_text_key", "template").orderBy(F.desc("covered"), "start")
    kept = stage(found.withColumn("_n", F.row_number().over(best)).filter("_n = 1 or not passage"), "spans")
    places = kept.groupBy("_text_key").agg(F.array_sort(F.collect_list(F.struct("start", "label", "covered"))).alias("places"))
    keyed = docs.select("doc_id", _text_key())
    return look_up(keyed, places, ["_text_key"], F.col("doc_id"), how="inner").select("doc_id", F.inline("places")).select("doc_id", "label", "start", "covered")


def _text_key() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("_text_key")


def _sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    rows = ", ".join(f"({n}, '{t.label}', {str(t.base).lower()}, {t.k}, string_split('{t.text}', ' '))" for n, t in enumerate(templates))
    return f"""
WITH templates(template, label, base, k, parts) AS (VALUES {rows}),
grams AS (SELECT template, k, len(parts) AS length, pos, array_to_string(parts[pos + 1:pos + k], ' ') AS gram
          FROM (SELECT *, unnest(range(0, len(parts) - k + 1)) AS pos FROM templates)),
texts AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM documents),
places AS (SELECT r, words, unnest(range(0, len(words))) AS place FROM texts),
sized AS (SELECT r, place, {SHORT} AS k, array_to_string(words[place + 1:place + {SHORT}], ' ') AS gram FROM places WHERE place + {SHORT} <= len(words)
          UNION ALL SELECT r, place, {LONG}, array_to_string(words[place + 1:place + {LONG}], ' ') FROM places WHERE place + {LONG} <= len(words)),
hits AS (SELECT r, template, s.k, length, place - pos AS diagonal, pos FROM sized s JOIN grams g ON s.gram = g.gram AND s.k = g.k),
covers AS (SELECT a.r, a.template, a.diagonal, count(DISTINCT b.pos + i) / CAST(a.length AS DOUBLE) AS covered
           FROM (SELECT DISTINCT r, template, k, length, diagonal FROM hits) a
           JOIN hits b ON a.r = b.r AND a.template = b.template AND abs(a.diagonal - b.diagonal) <= CASE WHEN a.k = {LONG} THEN {SHIFT} ELSE 0 END,
           unnest(range(0, a.k)) u(i)
           GROUP BY a.r, a.template, a.diagonal, a.length),
verified AS (SELECT c.*, t.label, t.base, t.k FROM covers c JOIN templates t USING (template) WHERE t.k = {LONG} OR covered = 1)
SELECT any_value(t.doc_id) AS doc_id, CAST(any_value(len(t.words)) AS BIGINT) AS n_words,
       CAST(count(diagonal) FILTER (base) AS BIGINT) AS n_base,
       CAST(min(diagonal) FILTER (base) AS BIGINT) AS first_word, CAST(max(diagonal) FILTER (base) AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (k = {SHORT} OR covered >= {COVERED})), ','), '') AS labels,
       coalesce(max(covered), 0.0) AS score
FROM texts t LEFT JOIN verified v ON t.r = v.r GROUP BY t.r
"""


ORACLE_SQL = _sql()
