"""Ranges of a long column of about equal counts, from the column alone (no other column is read for it)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cuts_of(ids: DataFrame, column: str, n: int) -> list[int]:
    """At most n - 1 ascending values that cut the column into ranges (value <= cut goes left)."""
    if n <= 1:
        return []
    found = ids.select(column).approxQuantile(column, [k / n for k in range(1, n)], 1 / (20 * n))
    return sorted({int(x) for x in found})


def range_of(column: str, cuts: list[int]) -> Column:
    """How many cuts are below the value, found in two steps of about the square root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, math.isqrt(len(cuts)))
    lits = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    below = lambda array: F.size(F.filter(array, lambda c: c < F.col(column)))
    coarse = below(lits(cuts[width - 1 :: width]))
    return (coarse * width + below(F.slice(lits(cuts), coarse * width + 1, F.lit(width)))).cast("int")
