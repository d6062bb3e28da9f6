"""Joins: equality joins with one visible key, as-of join, semi and anti forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def equi_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", prefix: str = "right_") -> DataFrame:
    """INNER / LEFT / RIGHT / FULL on equal names. Null keys never match; a name on both sides keeps the left one's
    place and the right one gets ``prefix``."""
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    return left.join(right.withColumnsRenamed({c: prefix + c for c in clash}), on=keys, how=how)


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, *, how: str = "inner", tiebreak: str | None = None, bucket: str | None = None, prefix: str = "right_") -> DataFrame:
    """Per left row the right row of its key with the greatest ``ts`` not after it.

    One shuffle and one sort: both sides are united and a window carries the last right row forward. ``inner`` drops rows
    without a match, ``left`` keeps them. Null keys and null times match nothing. At equal right times the highest
    ``tiebreak`` wins. ``bucket``: a unit such as 'day' splits a hot key by time; the last right row of every bucket, which the
    right side alone gives, is carried into the later ones through a second, aggregated window.
    """
    pay = [c for c in right.columns if c not in keys and c != ts]
    out = {c: (prefix + c if c in left.columns else c) for c in [*pay, ts]}
    key = [F.col(k) for k in keys]
    tie = F.col(tiebreak) if tiebreak else F.lit(0)
    slot = F.date_trunc(bucket, F.col(ts)) if bucket else F.lit(0)
    r = right.dropna(subset=[*keys, ts]).select(*key, F.col(ts).alias("_t"), F.lit(0).alias("_side"), tie.alias("_tie"), slot.alias("_slot"), F.struct(F.col(ts), *pay).alias("_r"), F.lit(None).cast(left.select(F.struct("*")).dtypes[0][1]).alias("_l"))
    lefts = left.select(*key, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), slot.alias("_slot"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct("*").alias("_l"))
    w = Window.partitionBy(*keys, "_slot").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    m = r.unionByName(lefts).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).filter("_side = 1")
    if bucket:
        ends = r.groupBy(*keys, "_slot").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_end"))
        slots = left.dropna(subset=[*keys, ts]).select(*key, slot.alias("_slot"), F.lit(None).cast(r.schema["_r"].dataType).alias("_end")).distinct()
        ends = ends.unionByName(slots).groupBy(*keys, "_slot").agg(F.first("_end", ignorenulls=True).alias("_end"))
        carry = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(carry)).select(*[F.col(k).alias(f"_k{i}_") for i, k in enumerate(keys)], F.col("_slot").alias("_s"), "_before")
        on = [F.col(k) == F.col(f"_k{i}_") for i, k in enumerate(keys)] + [F.col("_slot") == F.col("_s")]
        m = m.join(ends, on, "left").withColumn("_m", F.coalesce("_m", "_before"))
    ok = F.col("_t").isNotNull()
    for k in key:
        ok = ok & k.isNotNull()
    m = m.withColumn("_m", F.when(ok, F.col("_m")))
    m = m.filter(F.col("_m").isNotNull()) if how == "inner" else m
    return m.select("_l.*", *[F.col("_m").getField(c).alias(out[c]) for c in [ts, *pay]])


def in_values(df: DataFrame, column: str, values: DataFrame, negate: bool = False) -> DataFrame:
    """IN / NOT IN over a one-column frame, inner nulls ignored: an empty list is FALSE, its negation TRUE."""
    inner = values.select(F.col(values.columns[0]).alias("_in")).dropna().distinct()
    if not negate:
        return df.join(inner, F.col(column) == F.col("_in"), "left_semi")
    return df.filter(F.col(column).isNotNull() | ~exists(inner)).join(inner, F.col(column) == F.col("_in"), "left_anti")


def exists(values: DataFrame):
    """EXISTS of an uncorrelated frame as a scalar condition: one row at most is read."""
    return F.lit(not values.isEmpty())
