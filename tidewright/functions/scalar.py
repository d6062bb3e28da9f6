"""Scalar functions with soft nulls: arithmetic in doubles, and null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num(c: Column) -> Column:
    return c.try_cast("double")


def soft_add(a: Column, b: Column) -> Column:
    return F.try_add(num(a), num(b))


def soft_sub(a: Column, b: Column) -> Column:
    return F.try_subtract(num(a), num(b))


def soft_mul(a: Column, b: Column) -> Column:
    return F.try_multiply(num(a), num(b))


def soft_div(a: Column, b: Column) -> Column:
    """Null for a zero divisor."""
    return F.try_divide(num(a), num(b))


def floor_d(c: Column) -> Column:
    return F.floor(num(c)).cast("double")


def ceil_d(c: Column) -> Column:
    return F.ceil(num(c)).cast("double")


def round_d(c: Column) -> Column:
    """Half away from zero."""
    return F.round(num(c)).cast("double")


def substr(c: Column, start: int, length: int | None = None) -> Column:
    """1-based; a start below 1 counts as 1."""
    s = max(start, 1)
    return F.substring(c, s, 2**31 - 1 if length is None else max(length, 0))


def concat(*cs: Column) -> Column:
    """Null counts as ''."""
    return F.concat_ws("", *cs)


def fold_eq(c: Column, literal: str, upper: bool = True) -> Column:
    """UPPER(c) = literal with the literal folded as well."""
    return (F.upper(c) if upper else F.lower(c)) == (literal.upper() if upper else literal.lower())


def fold_like(c: Column, pattern: str, upper: bool = True) -> Column:
    return (F.upper(c) if upper else F.lower(c)).like(pattern.upper() if upper else pattern.lower())


def now_micros() -> Column:
    """Frozen for the query."""
    return F.unix_micros(F.current_timestamp())
