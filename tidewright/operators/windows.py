"""Window columns with explicit ROWS frames."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def frame(partition: list[str], order: list[Column | str], preceding: int | None = None) -> Window:
    """ROWS from ``preceding`` rows (None: all) before the current row up to it, also if nothing orders the rows."""
    start = Window.unboundedPreceding if preceding is None else -preceding
    return Window.partitionBy(*partition).orderBy(*(order or [F.lit(0)])).rowsBetween(start, Window.currentRow)


def rolling(fn: str, column: str, partition: list[str], order: list[Column | str], preceding: int | None = None) -> Column:
    """SUM / AVG / MIN / MAX as double, COUNT as long, over that frame."""
    if fn == "count":
        return F.count(F.lit(1) if column == "*" else F.col(column)).over(frame(partition, order, preceding))
    return getattr(F, fn)(F.col(column).cast("double")).over(frame(partition, order, preceding))


def ranked(fn: str, partition: list[str], order: list[Column | str], *args) -> Column:
    """row_number, rank, dense_rank, ntile, lag and lead, ranks as long."""
    c = getattr(F, fn)(*args).over(Window.partitionBy(*partition).orderBy(*order))
    return c.cast("long") if fn in ("row_number", "rank", "dense_rank", "ntile") else c
