"""Files as DataFrames: open, read, write and rewrite with status codes, lines, reports, source trees, JDBC.

Record files themselves are the data source of ``records``; line files are Spark's text source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.sources.records import list_files, read_fixed, read_variable, variable_status, write_fixed, write_variable
from recordloom.sources.staged import numbered, settled

__all__ = ["list_files", "read_fixed", "read_variable", "variable_status", "write_fixed", "write_variable"]

# File status codes and their descriptions.
FILE_STATUS = {
    "00": "Successful completion", "10": "End of file reached", "22": "Duplicate key", "23": "Record not found", "34": "Boundary violation",
    "35": "File not found", "39": "File attributes conflict", "41": "File already open", "42": "File not open", "46": "Read attempted on file not open",
    "47": "Read attempted on file not open for input", "48": "Write attempted on file not open for output", "49": "Rewrite/Delete attempted improperly",
    "51": "Record locked by another user", "90": "General I/O error",
}
# The outcome texts of a status match ("00" is success).
STATUS_OUTCOME = {
    "10": "End of file", "22": "Duplicate key", "23": "Record not found", "30": "Permanent error", "35": "File not found", "39": "File attribute conflict",
    "41": "File already open", "42": "File not open", "43": "DELETE without prior READ", "44": "REWRITE without prior READ", "46": "READ after end of file",
    "47": "READ on file not open for input", "48": "WRITE on file not open for output", "49": "REWRITE/DELETE on file not open for I-O",
}


def status_description(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FILE_STATUS.items() for x in kv])
    return F.coalesce(F.element_at(table, code), F.concat(F.lit("Unknown status: "), code))


def status_outcome(code: Column) -> Column:
    """Null for success, else the outcome's text."""
    table = F.create_map(*[F.lit(x) for kv in STATUS_OUTCOME.items() for x in kv])
    return F.when(code != "00", F.coalesce(F.element_at(table, code), F.concat(F.lit("Unknown file status: "), code)))


def status_success(code: Column) -> Column:
    return code.isin("00", "10")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path, pattern or folder names a file, in any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(where)
    return found is not None and len(found) > 0


def open_input(spark: SparkSession, path: str, length: int) -> tuple[DataFrame | None, str]:
    """(records, status): "00", or None and "35" if there is no such file."""
    return (read_fixed(spark, path, length), "00") if exists(spark, path) else (None, "35")


class RecordFile:
    """A file of fixed-length records, opened in one of four modes; every operation leaves its ``status``.

    INPUT and I-O need a file (35); OUTPUT replaces it, EXTEND adds to it, and both make one. What a mode doesn't allow
    leaves 47 (read), 48 (write) or 49 (rewrite), without touching the file; 41 is a file opened twice, 42 one closed
    twice, 30 a path that no file system serves. REWRITE writes the file anew, in order, and replaces it when done.
    """

    READS, WRITES = ("INPUT", "I-O"), ("OUTPUT", "EXTEND", "I-O")

    def __init__(self, spark: SparkSession, path: str, length: int):
        self.spark, self.path, self.length, self.mode, self.status, self.fresh = spark, path, length, None, "00", False

    def open(self, mode: str) -> str:
        if mode not in {*self.READS, *self.WRITES}:
            raise ValueError(mode)
        if self.mode:
            self.status = "41"
            return self.status
        self.status = "00"
        try:
            list_files(self.path)
        except FileNotFoundError:
            self.status = "35" if mode in self.READS else "00"
        except ValueError:
            self.status = "30"
        if self.status == "00":
            self.mode, self.fresh = mode, mode == "OUTPUT"
        return self.status

    def close(self) -> str:
        self.status = "00" if self.mode else "42"
        self.mode = None
        return self.status

    def read(self) -> DataFrame | None:
        """(position, record), or None with status 47."""
        self.status = "00" if self.mode in self.READS else "47"
        return read_fixed(self.spark, self.path, self.length) if self.status == "00" else None

    def write(self, records: DataFrame) -> str:
        """Records in the order of their partitions, behind those that are there."""
        self.status = "00" if self.mode in self.WRITES else "48"
        if self.status == "00":
            write_fixed(records, self.path, self.length, "overwrite" if self.fresh else "append")
            self.fresh = False
        return self.status

    def rewrite(self, changes: DataFrame) -> DataFrame | None:
        """Replace records by position. (position, record, file_status) of the changes, 00 or 23; None with status 49."""
        self.status = "00" if self.mode == "I-O" else "49"
        if self.status != "00":
            return None
        done, judged = rewrite(read_fixed(self.spark, self.path, self.length), settled(changes))
        judged = settled(judged)
        write_fixed(done.repartitionByRange("position").sortWithinPartitions("position"), self.path, self.length)
        return judged


def rewrite(records: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """REWRITE by position: (records with the changed ones replaced, changes with file_status 00 or 23). Both are
    (position, record); of changes of one position the greatest counts."""
    new = changes.groupBy("position").agg(F.max("record").alias("_new"))
    done = records.join(new, "position", "left").select("position", F.coalesce("_new", "record").alias("record"))
    known = records.select("position").distinct().withColumn("_hit", F.lit(True))
    return done, changes.join(known, "position", "left").withColumn("file_status", F.when(F.col("_hit"), "00").otherwise("23")).drop("_hit")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).text(path)


def by_record_type(df: DataFrame, type_code: Column, codes: dict[str, str]) -> dict[str, DataFrame]:
    """Split a file of several record types: name -> rows whose code is the given one."""
    return {name: df.filter(type_code == code) for name, code in codes.items()}


def reconcile_trailer(details: DataFrame, amount: Column, trailer: DataFrame) -> DataFrame:
    """trailer (count, amount) against the details: counted, summed, and whether both agree."""
    found = details.agg(F.count(F.lit(1)).alias("counted"), F.coalesce(F.sum(amount), F.lit(0)).alias("summed"))
    both = trailer.select("count", "amount", F.lit(1).alias("k")).join(F.broadcast(found.withColumn("k", F.lit(1))), "k").drop("k")  # one row on either side
    return both.withColumn("agrees", (F.col("count") == F.col("counted")) & (F.col("amount") == F.col("summed")))


def advancing(df: DataFrame, order: list[Column], line: Column, blank_before: Column, page: Column | None = None, lines_per_page: int = 55) -> DataFrame:
    """Report lines: ``blank_before`` empty lines before each, a form feed before a line whose ``page`` is true, and
    the page of each detail. Numbering is by the given total order."""
    lines = F.concat(F.array_repeat(F.lit(""), blank_before), F.array(F.when(page, F.concat(F.lit("\f"), line)).otherwise(line) if page is not None else line))
    return numbered(df, order).select("rn", (F.floor((F.col("rn") - 1) / lines_per_page) + 1).alias("page"), F.posexplode(lines).alias("part", "text"))


def file_control(spark: SparkSession, source: DataFrame) -> DataFrame:
    """The catalog of SELECT … ASSIGN entries of sources (path, content)."""
    entries = F.regexp_extract_all("content", F.lit(r"(?is)\bSELECT\s+(?:OPTIONAL\s+)?(.+?)\.(?:\s|$)"), F.lit(1))
    one = source.select("path", F.explode(entries).alias("e"))
    clause = lambda pattern: F.nullif(F.upper(F.regexp_extract("e", pattern, 1)), F.lit(""))
    return one.select(
        "path",
        F.upper(F.regexp_extract("e", r"^(\S+)", 1)).alias("file"),
        F.regexp_replace(F.regexp_extract("e", r"(?is)\bASSIGN\s+(?:TO\s+)?(\S+)", 1), "[\"']", "").alias("assign"),
        F.coalesce(clause(r"(?is)\bORGANIZATION\s+(?:IS\s+)?(LINE\s+SEQUENTIAL|\S+)"), F.lit("SEQUENTIAL")).alias("organization"),
        F.coalesce(clause(r"(?is)\bACCESS\s+(?:MODE\s+)?(?:IS\s+)?(\S+)"), F.lit("SEQUENTIAL")).alias("access"),
        clause(r"(?is)\bRECORD\s+KEY\s+(?:IS\s+)?(\S+)").alias("record_key"),
        clause(r"(?is)\bSTATUS\s+(?:IS\s+)?(\S+)").alias("status"),
    )


def source_tree(spark: SparkSession, root: str, extensions: str = "cbl|cob|cpy|jcl|jclproc") -> DataFrame:
    """(path, type, content) of the source files under ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("wholetext", "true").text(root).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    return files.filter(F.lower("path").rlike(f"\\.({extensions})$")).select("path", file_type(F.col("path")).alias("type"), "content")


def file_type(path: Column) -> Column:
    extension = F.lower(F.element_at(F.split(path, "\\."), -1))
    return F.when(extension.isin("cbl", "cob"), "cobol").when(extension == "cpy", "copybook").when(extension.isin("jcl", "jclproc"), "jcl").otherwise("unknown")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
