"""Delta streams in batch form: what a subscriber sees between two states.

Both states are keyed frames; a full outer join on the key, null-safe, classifies each key once. This net form is the
conflated stream of the interval: one delta a key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators.snapshot import META, two_states


def _paired(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    a = before.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.struct("*").alias("_old"))
    b = after.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.struct("*").alias("_new"))
    on = reduce(lambda x, y: x & y, [F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}")) for i in range(len(keys))])
    return a.join(b, on, "full")


def classify(before: DataFrame, after: DataFrame, keys: list[str], where: str | None = None, touched: DataFrame | bool | None = None) -> DataFrame:
    """``_delta`` in add / update / oof / remove, and the row (the old one for oof and remove).

    add: enters the filter; update: stays in it and was touched; oof: leaves it by an update; remove: deleted. UNKNOWN
    counts as not matching. touched: keys written in the interval, or True for all (default: the rows that differ).
    """
    flag = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    p = _paired(before.withColumn("_in", flag), after.withColumn("_in", flag), keys)
    was, now = F.coalesce(F.col("_old._in"), F.lit(False)), F.coalesce(F.col("_new._in"), F.lit(False))
    gone = F.col("_new").isNull()
    kind = F.when(~was & now, "add").when(was & now, "update").when(was & ~gone, "oof").when(was & gone, "remove")
    p = p.withColumn("_delta", kind).filter(F.col("_delta").isNotNull())
    key = [F.coalesce(F.col(f"_b{i}"), F.col(f"_a{i}")).alias(k) for i, k in enumerate(keys)]
    row = [F.when(F.col("_delta").isin("oof", "remove"), F.col("_old").getField(c)).otherwise(F.col("_new").getField(c)).alias(c) for c in after.columns if c not in keys]
    if touched is None:
        p = p.filter((F.col("_delta") != "update") | ~F.col("_old").eqNullSafe(F.col("_new")))
        return p.select("_delta", *key, *row)
    if touched is True:
        return p.select("_delta", *key, *row)
    t = touched.select(*keys).distinct().withColumn("_hit", F.lit(True))
    out = p.select("_delta", *key, *row)
    on = reduce(lambda x, y: x & y, [out[k].eqNullSafe(t[k]) for k in keys])
    return out.join(t, on, "left").filter((F.col("_delta") != "update") | F.col("_hit")).select("_delta", *[out[c] for c in out.columns[1:]])


def net(changelog: DataFrame, keys: list[str], seq: int, where: str) -> DataFrame:
    """What ``classify`` says of the states as of ``seq`` and of now, from one scan and one shuffle of the log."""
    p = two_states(changelog.withColumn("_in", F.coalesce(F.expr(where), F.lit(False))), keys, seq)
    was, now = F.coalesce(F.col("_old._in"), F.lit(False)), F.coalesce(F.col("_new._in"), F.lit(False))
    gone = F.col("_new").isNull()
    kind = F.when(~was & now, "add").when(was & now & F.col("_hit"), "update").when(was & ~now & ~gone, "oof").when(was & gone, "remove")
    p = p.withColumn("_delta", kind).filter(F.col("_delta").isNotNull())
    row = F.when(F.col("_delta").isin("oof", "remove"), F.col("_old")).otherwise(F.col("_new"))
    return p.select("_delta", *keys, *[row.getField(c).alias(c) for c in changelog.columns if c not in (*keys, *META)])


def sparse(before: DataFrame, after: DataFrame, keys: list[str], where: str | None = None) -> DataFrame:
    """Deltas whose updates carry only the changed fields as JSON beside the key; no-op updates are not sent; oof and
    remove carry the key only. Fields changed to null are omitted, as JSON leaves nulls out."""
    flag = F.coalesce(F.expr(where), F.lit(False)) if where else F.lit(True)
    p = _paired(before.withColumn("_in", flag), after.withColumn("_in", flag), keys)
    was, now = F.coalesce(F.col("_old._in"), F.lit(False)), F.coalesce(F.col("_new._in"), F.lit(False))
    cols = [c for c in after.columns if c not in keys]
    changed = [F.when(~F.col("_old").getField(c).eqNullSafe(F.col("_new").getField(c)) | ~was, F.col("_new").getField(c)).alias(c) for c in cols]
    differs = reduce(lambda x, y: x | y, [~F.col("_old").getField(c).eqNullSafe(F.col("_new").getField(c)) for c in cols])
    kind = F.when(~was & now, "add").when(was & now & differs, "update").when(was & ~now & F.col("_new").isNotNull(), "oof").when(was & F.col("_new").isNull(), "remove")
    p = p.withColumn("_delta", kind).filter(F.col("_delta").isNotNull())
    payload = F.when(F.col("_delta").isin("add", "update"), F.to_json(F.struct(*changed)))
    return p.select("_delta", *[F.coalesce(F.col(f"_b{i}"), F.col(f"_a{i}")).alias(k) for i, k in enumerate(keys)], payload.alias("_payload"))


def per_event(changelog: DataFrame, keys: list[str], where: str, columns: list[str]) -> DataFrame:
    """Every delta of every event, in order: each row against the one before it of its key."""
    w = Window.partitionBy(*keys).orderBy("_seq")
    live = F.coalesce(F.expr(where), F.lit(False)) & (F.col("_op") != "D")
    e = changelog.withColumn("_now", live).withColumn("_was", F.coalesce(F.lag("_now").over(w), F.lit(False)))
    kind = F.when(~F.col("_was") & F.col("_now"), "add").when(F.col("_was") & F.col("_now"), "update").when(F.col("_was") & (F.col("_op") == "D"), "remove").when(F.col("_was"), "oof")
    return e.withColumn("_delta", kind).filter(F.col("_delta").isNotNull()).select("_seq", "_delta", *keys, *columns)


def conflate(deltas: DataFrame, keys: list[str], every: int) -> DataFrame:
    """Coalesces per-event deltas of each key in windows of ``every`` sequence numbers. The first and last events decide:
    in at the end is add (if it was out at the start) or update; out at the end is nothing, or the last oof / remove."""
    slot = F.floor(F.col("_seq") / F.lit(every))
    first = F.min_by("_delta", "_seq")
    last = F.max_by(F.struct(*deltas.columns), "_seq")
    g = deltas.groupBy(*keys, slot.alias("_slot")).agg(first.alias("_first"), last.alias("_last"))
    out_before, in_after = F.col("_first") == "add", F.col("_last._delta").isin("add", "update")
    kind = F.when(out_before & in_after, "add").when(in_after, "update").when(~out_before, F.col("_last._delta"))
    g = g.withColumn("_delta", kind).filter(F.col("_delta").isNotNull())
    return g.select("_slot", F.col("_last._seq").alias("_seq"), "_delta", *keys, *[F.col("_last").getField(c).alias(c) for c in deltas.columns if c not in ("_seq", "_delta", *keys)])


def top_n(state: DataFrame, order: list[Column], n: int, rank: str = "_rank") -> DataFrame:
    """The ranked window of a state: a bounded top-k (n is the feature), then ranks over these n rows only."""
    top = state.orderBy(*order).limit(n)
    return top.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))


def topn_deltas(before: DataFrame, after: DataFrame, keys: list[str], order: list[Column], n: int, more: DataFrame | None = None) -> DataFrame:
    """Entrants are added, rows pushed out are oof, deleted ones remove, changed ones in the window update. ``more``: keys that
    are alive besides those of ``after``, where that is only the best of the state."""
    a, b = top_n(before, order, n).drop("_rank"), top_n(after, order, n).drop("_rank")
    d = classify(a, b, keys)
    alive = after.select(*keys)
    alive = (alive.union(more.select(*keys)).distinct() if more is not None else alive).withColumn("_alive", F.lit(True))
    on = reduce(lambda x, y: x & y, [d[k].eqNullSafe(alive[k]) for k in keys])
    j = d.join(alive, on, "left")
    kind = F.when((F.col("_delta") == "remove") & F.col("_alive"), "oof").otherwise(F.col("_delta"))
    return j.select(kind.alias("_delta"), *[d[c] for c in d.columns if c != "_delta"])


def group_deltas(before: DataFrame, after: DataFrame, groups: list[str]) -> DataFrame:
    """Diff of two aggregate results keyed by their groups; a group failing HAVING is simply absent."""
    return classify(before, after, groups)


def apply_deltas(snapshot: DataFrame, deltas: DataFrame, keys: list[str]) -> DataFrame:
    """snapshot + deltas: the later snapshot of the filtered set."""
    on = reduce(lambda x, y: x & y, [snapshot[k].eqNullSafe(deltas[k]) for k in keys])
    kept = snapshot.join(deltas, on, "left_anti")
    return kept.unionByName(deltas.filter(F.col("_delta").isin("add", "update")).drop("_delta"))
