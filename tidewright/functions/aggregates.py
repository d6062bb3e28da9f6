"""Aggregates by the names and meanings of the dialect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    """SUM without overflow errors: null where a long would overflow."""
    return F.try_sum(c)


def stddev(c: Column) -> Column:
    """STDDEV is the population one."""
    return F.stddev_pop(c)


def variance(c: Column) -> Column:
    """VARIANCE is the population one."""
    return F.var_pop(c)


def percentile_cont(c: Column, q: float) -> Column:
    """Exact, linear between neighbours at q * (n - 1)."""
    if not 0 <= q <= 1:
        raise ValueError("a percentile is in [0, 1]")
    return F.percentile(c, F.lit(q))


def median(c: Column) -> Column:
    return F.median(c)
