"""CALL: subprograms over frames. A subprogram is a function of parameter columns that gives the columns it changes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Takes the parameters in order; gives new values by parameter number (from 0), and "returning" for RETURNING.
Program = Callable[..., Mapping[int | str, Column]]


def call(df: DataFrame, programs: Mapping[str, Program], name: str | Column, using: Sequence[str | Column], content: Sequence[int] = (), returning: str | None = None, exception: str = "exception") -> DataFrame:
    """CALL name USING parameters RETURNING column, for every row.

    A column name is passed BY REFERENCE: what the subprogram changes is in the column afterwards. Its number in
    ``content`` makes it BY CONTENT, as an expression always is: changes are lost. ``name`` may be a column, then each
    row calls its own program. Rows whose program isn't there are unchanged, null in ``returning`` and true in the column
    ``exception`` (ON EXCEPTION goes on with those rows, NOT ON EXCEPTION with the others).
    """
    called = F.upper(F.trim(F.lit(name) if isinstance(name, str) else name))
    values = [F.col(u) if isinstance(u, str) else u for u in using]
    results = {n.upper(): p(*values) for n, p in programs.items()}

    def chosen(key: int | str, otherwise: Column) -> Column:
        out = otherwise
        for program, result in results.items():
            if key in result:
                out = F.when(called == program, result[key]).otherwise(out)
        return out

    changed = {u: chosen(k, F.col(u)) for k, u in enumerate(using) if isinstance(u, str) and k not in content}
    if returning:
        changed[returning] = chosen("returning", F.lit(None))
    changed[exception] = ~F.coalesce(called.isin(list(results)), F.lit(False))
    return df.withColumns(changed)
