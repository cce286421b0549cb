"""Source-corpus analytics: what programs, copybooks and job control mention, as columns over (path, content)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.sources.files import file_type

# Patterns of the reference behaviour; neither has a word boundary before it.
CALL, COPY, PROGRAM_ID = r"(?i)CALL\s+['\"]?([A-Z0-9-]+)['\"]?", r"(?i)COPY\s+([A-Z0-9-]+)", r"(?i)PROGRAM-ID\.\s+([A-Z0-9-]+)"
JOB, STEP, CONDITION = r"(?i)//([A-Z0-9#@$]+)\s+JOB", r"(?i)//([A-Z0-9#@$]+)\s+EXEC\s+PGM=([A-Z0-9-]+)", r"(?i)(COND=\([^)]*\))"


def program_id(content: Column) -> Column:
    return F.regexp_extract(content, PROGRAM_ID, 1)


def _stripped(content: Column) -> Column:
    """Without comment lines (an asterisk in column 7, or *> to the end of a line)."""
    return F.regexp_replace(F.regexp_replace(content, r"(?m)^.{6}[*/].*$", ""), r"\*>.*", "")


def calls(content: Column, strict: bool = False) -> Column:
    """Distinct targets in order of first mention. strict: whole words outside comments, quoted targets only."""
    if strict:
        return F.array_distinct(F.regexp_extract_all(_stripped(content), F.lit(r"(?i)(?<![A-Z0-9-])CALL\s+['\"]([A-Z0-9-]+)['\"]"), F.lit(1)))
    return F.array_distinct(F.regexp_extract_all(content, F.lit(CALL), F.lit(1)))


def copies(content: Column, strict: bool = False) -> Column:
    if strict:
        return F.array_distinct(F.regexp_extract_all(_stripped(content), F.lit(r"(?i)(?<![A-Z0-9-])COPY\s+([A-Z0-9-]+)"), F.lit(1)))
    return F.array_distinct(F.regexp_extract_all(content, F.lit(COPY), F.lit(1)))


def copy_statements(content: Column) -> Column:
    """array<struct<name, library, replacing>> of COPY statements."""
    pattern = r"(?is)\bCOPY\s+([A-Z0-9-]+)(?:\s+(?:OF|IN)\s+([A-Z0-9-]+))?(?:\s+REPLACING\s+(.*?))?\s*\."
    get = lambda k: F.regexp_extract_all(content, F.lit(pattern), F.lit(k))
    return F.arrays_zip(get(1).alias("name"), get(2).alias("library"), get(3).alias("replacing"))


def divisions(content: Column) -> dict[str, Column]:
    return {f"has_{d.lower()}": content.rlike(rf"(?i){d}\s+DIVISION") for d in ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")}


def line_count(content: Column) -> Column:
    """Lines of content that isn't blank, else 0."""
    return F.when(F.trim(content) != "", F.size(F.split(content, "\n"))).otherwise(0).cast("long")


def identification(content: Column) -> dict[str, Column]:
    clause = lambda name: F.nullif(F.trim(F.regexp_extract(content, rf"(?im)\b{name}\.\s*(.*?)\.?\s*$", 1)), F.lit(""))
    names = {"author": "AUTHOR", "installation": "INSTALLATION", "date_written": "DATE-WRITTEN", "date_compiled": "DATE-COMPILED", "security": "SECURITY", "remarks": "REMARKS"}
    return {"program_id": program_id(content)} | {k: clause(v) for k, v in names.items()}


def lines(df: DataFrame, content: str = "content") -> DataFrame:
    return df.select(*[c for c in df.columns if c != content], F.posexplode(F.split(content, r"\r?\n")).alias("line_no", "line"))


def job_steps(jcl: DataFrame) -> DataFrame:
    """(path, job, step_no, step, program, cond) of job control (path, content); COND belongs to the step it follows."""
    job = jcl.select("path", F.regexp_extract("content", JOB, 1).alias("job"), "content")
    parts = lines(job).withColumn("step", F.nullif(F.regexp_extract("line", STEP, 1), F.lit(""))).withColumn("program", F.regexp_extract("line", STEP, 2)).withColumn("cond", F.nullif(F.regexp_extract("line", CONDITION, 1), F.lit("")))
    w = Window.partitionBy("path").orderBy("line_no")
    parts = parts.filter("step is not null or cond is not null").withColumn("step_no", F.count("step").over(w)).filter("step_no > 0")
    return parts.groupBy("path", "job", "step_no").agg(F.first("step", ignorenulls=True).alias("step"), F.max(F.nullif(F.col("program"), F.lit(""))).alias("program"), F.max_by("cond", F.when(F.col("cond").isNotNull(), F.col("line_no"))).alias("cond"))


def programs(files: DataFrame) -> DataFrame:
    """(name, path, type, calls, copybooks, lines) of sources (path, content); a job calls the programs of its steps."""
    kind = file_type(F.col("path"))
    base = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    steps = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(?i)EXEC\s+PGM=([A-Z0-9-]+)"), F.lit(1)))
    none = F.expr("cast(array() as array<string>)")
    name = F.when(kind == "cobol", F.coalesce(F.nullif(program_id(F.col("content")), F.lit("")), base)).when(kind == "jcl", F.coalesce(F.nullif(F.regexp_extract("content", JOB, 1), F.lit("")), base)).otherwise(base)
    return files.select(
        F.upper(name).alias("name"), "path", kind.alias("type"),
        F.when(kind == "cobol", calls(F.col("content"))).when(kind == "jcl", steps).otherwise(none).alias("calls"),
        F.when(kind == "cobol", copies(F.col("content"))).otherwise(none).alias("copybooks"), line_count(F.col("content")).alias("lines"),
    )


def format_votes(df: DataFrame) -> DataFrame:
    """(path, fixed_votes, free_votes, format) from the first 50 lines of each source; ties are free."""
    parts = lines(df.select("path", "content")).filter("line_no < 50")
    line = F.col("line")
    column7 = (F.length(line) >= 7) & F.substr(line, F.lit(7), F.lit(1)).isin("*", "-", "/")
    numbered = (F.length(line) >= 7) & line.rlike(r"^\d{6}")
    votes = parts.groupBy("path").agg(
        (F.count_if(column7) + F.count_if(numbered)).alias("fixed_votes"),
        (F.count_if(F.startswith(F.trim(line), F.lit("*>"))) + F.count_if(line.rlike("^[A-Za-z]"))).alias("free_votes"),
    )
    return votes.withColumn("format", F.when(F.col("fixed_votes") > F.col("free_votes"), "fixed").otherwise("free"))


def fixed_lines(df: DataFrame) -> DataFrame:
    """(path, line_no, code): columns 8-72 without comment and debug lines, continuations joined to their line."""
    parts = lines(df.select("path", "content")).withColumn("mark", F.substr("line", F.lit(7), F.lit(1)))
    parts = parts.filter(~F.col("mark").isin("*", "/", "D", "d")).withColumn("code", F.rtrim(F.substr("line", F.lit(8), F.lit(65))))
    w = Window.partitionBy("path").orderBy("line_no")
    grouped = parts.withColumn("g", F.count_if(F.col("mark") != "-").over(w))
    piece = F.when(F.col("mark") == "-", F.regexp_replace(F.ltrim("code"), "^[\"']", "")).otherwise(F.col("code"))
    joined = grouped.groupBy("path", "g").agg(F.min("line_no").alias("line_no"), F.array_sort(F.collect_list(F.struct("line_no", piece.alias("piece")))).alias("parts"))
    return joined.select("path", "line_no", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("code")).filter("trim(code) <> ''")


def free_lines(df: DataFrame) -> DataFrame:
    """(path, line_no, code): up to *>, without >> directives and empty lines."""
    parts = lines(df.select("path", "content")).filter(~F.startswith(F.ltrim("line"), F.lit(">>")))
    return parts.select("path", "line_no", F.rtrim(F.substring_index("line", "*>", 1)).alias("code")).filter("trim(code) <> ''")


def metrics(df: DataFrame) -> DataFrame:
    """(path, format, line_count, token_count)."""
    token = r"'[^']*'|\"[^\"]*\"|[A-Za-z0-9][A-Za-z0-9_-]*|[^\sA-Za-z0-9]"
    counted = df.select("path", F.size(F.split("content", "\n")).cast("long").alias("line_count"), F.size(F.regexp_extract_all("content", F.lit(f"({token})"), F.lit(1))).cast("long").alias("token_count"))
    return format_votes(df).select("path", "format").join(counted, "path")


def validate_source(df: DataFrame) -> DataFrame:
    """(path, errors, warnings): a missing PROGRAM-ID is an error, a source without procedures is warned of."""
    content = F.col("content")
    keep = lambda test, text: F.filter(F.array(F.when(test, F.lit(text))), lambda x: x.isNotNull())
    return df.select("path", keep(program_id(content) == "", "Missing PROGRAM-ID").alias("errors"), keep(~content.rlike(r"(?i)PROCEDURE\s+DIVISION"), "No procedures found").alias("warnings"))


def sections(content: Column) -> dict[str, Column]:
    """The text of each division, so a reader of one needs no other."""
    order = ("IDENTIFICATION", "ENVIRONMENT", "DATA", "PROCEDURE")
    return {d.lower(): F.regexp_extract(content, rf"(?is)\b{d}\s+DIVISION\b(.*?)(?=\b(?:{'|'.join(order)})\s+DIVISION\b|$)", 1) for d in order}


def repository(url: Column, host: str = r"[^/:@]+\.[a-z]+") -> dict[str, Column]:
    """owner, repo and validity of an https or ssh address, without .git."""
    clean = F.regexp_replace(url, r"\.git$", "")
    pattern = rf"(?:^|//|@){host}[/:]([^/]+)/([^/?#]+)"
    owner, repo = (F.nullif(F.regexp_extract(clean, pattern, k), F.lit("")) for k in (1, 2))
    return {"owner": owner, "repo": repo, "valid": owner.isNotNull()}


def default_branch(requested: Column, existing: Column, default: Column) -> Column:
    """The requested branch if it exists, else the default."""
    return F.when(F.array_contains(existing, requested), requested).otherwise(default)


def search_programs(df: DataFrame, text: str, kind: str | None = None) -> DataFrame:
    """Rows whose name, path or used_by holds the text in any case, and whose type is ``kind``."""
    term = text.lower()
    found = F.contains(F.lower("name"), F.lit(term)) | F.contains(F.lower("path"), F.lit(term))
    if "used_by" in df.columns:
        found = found | F.exists("used_by", lambda u: F.contains(F.lower(u), F.lit(term)))
    return df.filter(found & (F.col("type") == kind if kind else F.lit(True)))
