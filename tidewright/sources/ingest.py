"""From JSON text to typed, flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ARRAY, MAX_DEPTH = 10, 32


def flat_columns(schema: T.StructType, max_array: int = MAX_ARRAY, max_depth: int = MAX_DEPTH) -> list[tuple[str, Column]]:
    """(dotted name, column) for every leaf: objects to ``a.b``, arrays to ``a[0]`` below ``max_array``."""
    out: list[tuple[str, Column]] = []

    def walk(name: str, col: Column, kind: T.DataType, depth: int) -> None:
        if depth > max_depth:
            return
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f"{name}.{f.name}" if name else f.name, col.getField(f.name), f.dataType, depth + 1)
        elif isinstance(kind, T.ArrayType):
            for i in range(max_array):
                walk(f"{name}[{i}]", F.get(col, F.lit(i)), kind.elementType, depth + 1)
        else:
            out.append((name, col))

    for f in schema.fields:
        walk(f.name, F.col(f"`{f.name}`"), f.dataType, 1)
    return out


def flatten(df: DataFrame, max_array: int = MAX_ARRAY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Nested columns as flat ones. Deeper branches and later elements are left out, as documented."""
    return df.select(*[c.alias(n) for n, c in flat_columns(df.schema, max_array, max_depth)])


def from_json_text(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    """The text column parsed by a declared schema and flattened; other columns stay."""
    rest = [c for c in df.columns if c != column]
    parsed = df.select(*rest, F.from_json(column, schema).alias(column))
    return flatten(parsed)


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN to null, so comparisons and aggregates agree."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def to_timestamp(c: Column) -> Column:
    """RFC 3339, naive (UTC), date only, or epoch numbers by magnitude: below 1e11 s, 1e14 ms, 1e17 µs, else ns."""
    n, s = c.try_cast("decimal(38,0)"), c.cast("string")
    a = F.abs(n)
    micros = F.when(a < 10**11, n * 1000000).when(a < 10**14, n * 1000).when(a < 10**17, n).otherwise(F.floor(n / 1000))
    return F.when(n.isNotNull(), F.timestamp_micros(micros.cast("long"))).otherwise(s.try_cast("timestamp"))


def to_bool(c: Column) -> Column:
    """true/1/yes/y and false/0/no/n in any case; other numbers are true unless 0."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("true", "1", "yes", "y"), True).when(s.isin("false", "0", "no", "n"), False).otherwise(s.try_cast("double") != 0)


def to_long(c: Column) -> Column:
    """Integers and integer strings; a fraction is null."""
    d = c.cast("string")
    return F.when(d.rlike(r"^\s*[+-]?\d+\s*$"), d.try_cast("long"))


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """String columns to the declared types by the rules above; missing ones are null, others are dropped."""
    how = {"boolean": to_bool, "timestamp": to_timestamp, "bigint": to_long, "int": lambda c: to_long(c).try_cast("int"), "binary": lambda c: F.unbase64(c)}
    cols = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None).cast("string")
        c = how[kind](c) if kind in how else c.try_cast(kind)
        cols.append((F.when(~F.isnan(c), c) if kind == "double" else c).alias(f.name))
    return df.select(*cols)


def widen(a: str, b: str) -> str:
    """Common type of two columns: int, bigint, double in this order; all else string."""
    order = ["int", "bigint", "double"]
    return a if a == b else order[max(order.index(a), order.index(b))] if a in order and b in order else "string"


def add_column(df: DataFrame, name: str, kind: str) -> DataFrame:
    """Online schema change: one nullable column at the end."""
    return df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))


def schema_change(before: list[str], after: list[str]) -> dict[str, list[str]]:
    """The frame a subscriber gets before the first delta of a new shape."""
    return {"added": [c for c in after if c not in before], "removed": [c for c in before if c not in after]}
