"""PIVOT, dynamic PIVOT and UNPIVOT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most values a pivot may spread into columns.
PIVOT_LIMIT = 100


def pivot(df: DataFrame, on: str, values: list, measures: dict[str, tuple[str, str]], anchors: list[str] | None = None) -> DataFrame:
    """Static pivot. measures: alias -> (function, column). Anchors default to every column that is neither pivoted nor
    measured. Anchors whose rows fall outside ``values`` still appear; a missing bucket is the empty aggregate: count 0,
    else null. Columns are named by the value, with ``_alias`` behind it if there are several measures."""
    if len(values) > PIVOT_LIMIT:
        raise ValueError(f"a pivot over {len(values)} values; the limit is {PIVOT_LIMIT}")
    used = {on, *(c for _, c in measures.values())}
    anchors = [c for c in df.columns if c not in used] if anchors is None else anchors
    aggs: list[Column] = []
    for v in values:
        hit = F.col(on) == F.lit(v)
        for alias, (fn, c) in measures.items():
            arg = F.when(hit, F.lit(1) if c == "*" else F.col(c))
            name = str(v) if len(measures) == 1 else f"{v}_{alias}"
            aggs.append((F.count_distinct(arg) if fn == "count_distinct" else getattr(F, fn)(arg)).alias(name))
    return df.groupBy(*anchors).agg(*aggs)


def pivot_any(df: DataFrame, on: str, measures: dict[str, tuple[str, str]], anchors: list[str] | None = None) -> DataFrame:
    """Dynamic pivot: the distinct non-null values, ascending. Never fetches more than the limit and one value."""
    found = [r[0] for r in df.select(on).dropna().distinct().limit(PIVOT_LIMIT + 1).collect()]
    return pivot(df, on, sorted(found), measures, anchors) if found else df.limit(0).select(*(anchors or [c for c in df.columns if c != on]))


def unpivot(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows, nulls dropped."""
    return df.unpivot(ids, columns, name, value).filter(F.col(value).isNotNull())
