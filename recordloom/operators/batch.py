"""Patterns of batch programs: match-merge, control breaks, validation, balances, groups of commits, sort and merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.sources.staged import numbered, running_total, settled


def signed_amount(kind: Column, amount: Column) -> Column:
    """Deposits and interest count up, withdrawals and fees down, anything else not at all."""
    return F.when(kind.isin("DP", "IN"), amount).when(kind.isin("WD", "FE"), -amount).otherwise(F.lit(0))


def match_merge(master: DataFrame, transactions: DataFrame, key: str, balance: str, kind: str, amount: str, date: str, sequence: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new master, exceptions, counts). Transactions are summed by key before the join, so one pass of each side is
    shuffled and a key with many transactions arrives as one row."""
    work = transactions.groupBy(key).agg(
        F.sum(signed_amount(F.col(kind), F.col(amount))).alias("_change"),
        F.max_by(date, sequence).alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    merged = master.join(work, key, "left")
    value = (F.col(balance) + F.coalesce("_change", F.lit(0))).cast(master.schema[balance].dataType)
    new = merged.select(*[value.alias(c) if c == balance else F.col(c) for c in master.columns], F.col("_last").alias("last_date"), F.coalesce("_n", F.lit(0)).cast("long").alias("applied"))
    exceptions = transactions.join(master.select(key), key, "left_anti").withColumn("reason", F.lit("NO MATCHING MASTER"))
    sides = master.select(key).withColumn("_m", F.lit(1)).join(work.select(key, "_n"), key, "full_outer")
    counts = sides.agg(
        F.count_if(F.col("_m").isNotNull() & F.col("_n").isNotNull()).alias("matched"),
        F.count_if(F.col("_m").isNotNull() & F.col("_n").isNull()).alias("master_only"),
        F.count_if(F.col("_m").isNull()).alias("transaction_only"),
        F.coalesce(F.sum(F.when(F.col("_m").isNotNull(), F.col("_n"))), F.lit(0)).alias("applied"),
        F.coalesce(F.sum(F.when(F.col("_m").isNull(), F.col("_n"))), F.lit(0)).alias("rejected"),
    )
    return new, exceptions, counts


def control_break(df: DataFrame, levels: Sequence[str], amount: Column) -> DataFrame:
    """Totals at every break from the innermost level to the grand total; ``break_level`` is 0 innermost."""
    depth = len(levels)
    rolled = df.rollup(*levels).agg(F.count(F.lit(1)).alias("row_count"), F.sum(amount).alias("total"), F.grouping_id().alias("gid"))
    return rolled.withColumn("break_level", F.element_at(F.array(*[F.lit(k) for k in range(depth + 1)]), (F.log2(F.col("gid") + 1) + 1).cast("int"))).drop("gid")


def break_flags(df: DataFrame, levels: Sequence[str], order: Sequence[str], within: str) -> DataFrame:
    """Whether each row starts a new value of each level, in ``order`` within values of ``within``.

    Rows are dealt by ranges of the order, however many rows one value of ``within`` has; the first row of a range is
    held against the last one of the range before.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = settled(df.repartitionByRange(n, within, *order).withColumn("_p", F.spark_partition_id()))
    last = ranged.groupBy(F.col(within).alias("_w"), F.col("_p").alias("_q")).agg(F.max_by(F.struct(*[F.col(c).alias(c) for c in levels]), F.struct(*order)).alias("_end"))
    ends = last.withColumn("_end", F.lag("_end").over(Window.partitionBy("_w").orderBy("_q")))  # a row for each range
    joined = ranged.join(ends, F.col(within).eqNullSafe(F.col("_w")) & (F.col("_p") == F.col("_q")))
    w = Window.partitionBy(within, "_p").orderBy(*order)
    before = F.coalesce(F.lag(F.struct(*levels)).over(w), F.col("_end"))
    out = joined.withColumn("_before", before)
    above = F.col("_before").isNull()
    for level in levels:
        above = above | ~F.col(level).eqNullSafe(F.col("_before")[level])
        out = out.withColumn(f"{level}_break", above)
    return out.select(*df.columns, *[f"{level}_break" for level in levels])


def page_numbers(df: DataFrame, within: str, order: Sequence[str], per_page: int = 55) -> DataFrame:
    """Line and page number of each row; numbering starts anew in each ``within``, whatever its share of the rows."""
    rn = F.col("_line")
    return numbered(df, order, "_line", [within]).select(*df.columns, (F.pmod(rn - 1, F.lit(per_page)) + 1).cast("long").alias("line"), (F.floor((rn - 1) / per_page) + 1).cast("long").alias("page"))


def running_balance(df: DataFrame, key: str, order: Sequence[str], amount: Column) -> DataFrame:
    """``balance``: the sum of ``amount`` up to and with each row of its key, whatever the key's share of the rows."""
    return running_total(df.withColumn("_amount", amount), order, "_amount", "balance", [key]).drop("_amount")


def commit_groups(df: DataFrame, within: str, order: Sequence[str], every: int) -> DataFrame:
    """The number of the commit that each row belongs to, ``every`` rows a commit in each ``within``."""
    return numbered(df, order, "_line", [within]).select(*df.columns, F.floor((F.col("_line") - 1) / every).cast("long").alias("commit_group"))


def commit_groups_global(df: DataFrame, order: str, every: int) -> DataFrame:
    """Commit numbers over a total order, without one task for all rows."""
    return numbered(df, [order], "_rn").select(*df.columns, F.floor((F.col("_rn") - 1) / every).cast("long").alias("commit_group"))


def validate(df: DataFrame, rules: Sequence[tuple[str, str, str, Column]], most: int = 20) -> DataFrame:
    """``errors`` array<struct<field, code, message>> of the rules (field, code, message, failing condition) that fail."""
    found = F.array(*[F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"), F.lit(m).alias("message"))) for f, c, m, bad in rules])
    return df.withColumn("errors", F.slice(F.filter(found, lambda e: e.isNotNull()), 1, most))


def transaction_rules(account: Column, amount: Column, date: Column, kind: Column) -> list[tuple[str, str, str, Column]]:
    """The validation of a transaction: fields as text, the amount as a number."""
    from recordloom.functions.expressions import is_numeric

    blank = account.isNull() | (F.trim(account) == "")
    digits = date.rlike(r"^\d+$")
    month, day = F.substr(date, F.lit(5), F.lit(2)), F.substr(date, F.lit(7), F.lit(2))
    limit = F.lit("999999999.99").cast("decimal(11,2)")
    # Fields, codes and messages.
    return [
        ("ACCOUNT", "E001", "ACCOUNT NUMBER IS BLANK", blank),
        ("ACCOUNT", "E002", "ACCOUNT NUMBER MUST BE NUMERIC", ~blank & ~is_numeric(account)),
        ("AMOUNT", "E010", "AMOUNT CANNOT BE ZERO", amount == 0),
        ("AMOUNT", "E011", "AMOUNT OUT OF VALID RANGE", (amount < -limit) | (amount > limit)),
        ("DATE", "E020", "DATE MUST BE NUMERIC YYYYMMDD", ~digits),
        ("DATE", "E021", "MONTH MUST BE 01-12", digits & ~month.between("01", "12")),
        ("DATE", "E022", "DAY MUST BE 01-31", digits & ~day.between("01", "31")),
        ("TYPE", "E030", "INVALID TRANSACTION TYPE", ~kind.isin("DP", "WD", "IN", "FE")),
    ]


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without errors, rows with errors)."""
    return df.filter(F.size("errors") == 0).drop("errors"), df.filter(F.size("errors") > 0)


def return_code(warnings: Column, errors: Column) -> Column:
    """0, 4 with warnings, 16 with errors."""
    return F.when(errors > 0, 16).when(warnings > 0, 4).otherwise(0)


def sort_file(df: DataFrame, keys: Sequence[tuple[str, str]], keep: Column | None = None, output: object = None) -> DataFrame:
    """SORT with an optional INPUT PROCEDURE (a filter) and OUTPUT PROCEDURE (a function of the sorted frame)."""
    rows = df if keep is None else df.filter(keep)
    rows = rows.orderBy(*[F.col(c).desc() if d.upper().startswith("D") else F.col(c).asc() for c, d in keys])
    return output(rows) if output else rows


def merge_files(files: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.unionByName, files).orderBy(*keys)


def progress(df: DataFrame, within: str, order: Sequence[str]) -> DataFrame:
    """The rounded percentage of a partition's rows done after each row, whatever the partition's share of the rows."""
    rows = numbered(df, order, "_line", [within], total="_of")
    return rows.select(*df.columns, F.round(F.col("_line") * 100.0 / F.col("_of")).cast("long").alias("percent"))


def publish_groups(df: DataFrame, path: str, group: str = "commit_group") -> DataFrame:
    """Write each commit group as a part of its own of the table at ``path``, and give the table. Groups that are there
    already were committed by an earlier run and are left alone, so a restart goes on after the last one."""
    from recordloom.sources.files import exists

    spark = df.sparkSession
    if exists(spark, f"{path}/{group}=*"):
        done = spark.read.parquet(path).select(F.col(group).alias("_g")).distinct()
        df = df.join(done, F.col(group) == F.col("_g"), "left_anti")
    df.repartition(group).write.mode("append").partitionBy(group).parquet(path)
    return spark.read.parquet(path)


def run_summary(df: DataFrame, success: Column) -> DataFrame:
    """One row: total, success, failed."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(success).alias("success"), F.count_if(~F.coalesce(success, F.lit(False))).alias("failed"))
