"""Incremental posting of transactions to a master (an extension: the batch programs modelled here have no streams).

``post_stream`` applies each micro-batch with the same match-merge as the batch job and publishes a new version of the
master; ``running_balances`` keeps a balance for each key in the state store; ``rate_windows`` counts requests in
sliding windows with a watermark.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from recordloom.operators.batch import match_merge


def post_stream(transactions: DataFrame, load: Callable[[], DataFrame], publish: Callable[[DataFrame, int], None], key: str, balance: str, kind: str, amount: str, date: str, sequence: str) -> DataStreamWriter:
    """Each micro-batch is merged into ``load()`` and handed to ``publish(master, batch_id)``.

    ``publish`` must be idempotent for a batch id (a version named by it), so a repeated batch posts once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        master = load()
        new, _, _ = match_merge(master, batch, key, balance, kind, amount, date, sequence)
        publish(new.select(*master.columns), batch_id)

    return transactions.writeStream.foreachBatch(apply)


def running_balances(changes: DataFrame, key: str, amount: str) -> DataFrame:
    """A stream of (key, change) to (key, balance, n) after each micro-batch; state is one pair a key."""
    kind = changes.schema[key].dataType.simpleString()

    def update(keys: tuple, parts: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        balance, n = state.get if state.exists else (0.0, 0)
        for part in parts:
            balance, n = balance + float(part["change"].sum()), n + len(part)
        state.update((balance, n))
        yield pd.DataFrame({key: [keys[0]], "balance": [balance], "n": [n]})

    rows = changes.select(key, F.col(amount).cast("double").alias("change"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, balance double, n long", "balance double, n long", "update", "NoTimeout")


def rate_windows(requests: DataFrame, ts: str, budget: int = 5000, length: str = "1 hour", slide: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Requests in sliding windows, and whether a window is over budget; works on batch and streaming frames."""
    counted = requests.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", (F.col("n") > budget).alias("over"))
