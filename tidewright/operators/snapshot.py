"""State of keyed topics from their changelog.

A changelog has ``_seq`` (order), ``_op`` ('U' full publish, 'P' partial publish, 'D' delete), ``_ts`` and payload
columns. All of these are one shuffle on the key with map-side partial aggregation: ``max_by`` keeps one row per key and
task, so a hot key never gathers its history in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = ("_seq", "_op", "_ts")


def latest_by_key(changelog: DataFrame, keys: list[str], keep_meta: bool = False, tombstones: bool = False) -> DataFrame:
    """Newest row per key; keys whose newest row is a delete are gone, unless ``tombstones`` are asked for. Without keys
    the topic is one row."""
    rest = [c for c in changelog.columns if c not in keys]
    newest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), "_seq").alias("_row")
    rows = changelog.groupBy(*keys).agg(newest)
    rows = rows if tombstones else rows.filter(F.col("_row._op") != "D")
    cols = [c for c in rest if keep_meta or c not in META]
    return rows.select(*keys, *[F.col("_row").getField(c).alias(c) for c in cols])


def as_of_seq(changelog: DataFrame, keys: list[str], seq: int, keep_meta: bool = False) -> DataFrame:
    """State after sequence ``seq``; the filter reaches the scan."""
    return latest_by_key(changelog.filter(F.col("_seq") <= seq), keys, keep_meta)


def seq_at(changelog: DataFrame, ts: Column, inclusive: bool = True) -> int:
    """The highest sequence number at (or, if not inclusive, before) ``ts``; -1 if none. One scalar, read before the query that
    uses it, whose filter then reaches the scan."""
    cut = changelog.filter(F.col("_ts") <= ts if inclusive else F.col("_ts") < ts).agg(F.max("_seq")).first()[0]
    return -1 if cut is None else cut


def as_of_ts(changelog: DataFrame, keys: list[str], ts: Column, keep_meta: bool = False) -> DataFrame:
    """State at a time, inclusive."""
    return as_of_seq(changelog, keys, seq_at(changelog, ts), keep_meta)


def two_states(changelog: DataFrame, keys: list[str], seq: int) -> DataFrame:
    """Per key the newest rows as of ``seq`` (_old) and of all (_new), null where none or deleted, and whether the key was written
    behind ``seq`` (_hit): one scan and one shuffle for both states."""
    rest = [c for c in changelog.columns if c not in keys]
    row, cut = F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("_seq") <= seq
    both = changelog.groupBy(*keys).agg(F.max_by(row, F.when(cut, F.col("_seq"))).alias("_old"), F.max_by(row, "_seq").alias("_new"), F.max(F.when(~cut, F.lit(True))).alias("_hit"))
    live = lambda c: F.when(F.col(f"{c}._op") != "D", F.col(c)).alias(c)
    return both.select(*keys, live("_old"), live("_new"), F.coalesce("_hit", F.lit(False)).alias("_hit"))


def split_states(both: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """The two states of ``two_states``, without sequence numbers; both read one shuffle."""
    cols = [f for f in both.schema["_new"].dataType.names if f not in META]
    side = lambda c: both.filter(F.col(c).isNotNull()).select(*keys, *[F.col(c).getField(f).alias(f) for f in cols])
    return side("_old"), side("_new")


def replay_since(changelog: DataFrame, *, bookmark: int | None = None, ts: Column | None = None) -> DataFrame:
    """Entries after a bookmark, or after the last entry strictly before ``ts``."""
    return changelog.filter(F.col("_seq") > (bookmark if bookmark is not None else seq_at(changelog, ts, inclusive=False)))


def expire(state: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Rows touched less than ``seconds`` before ``now``; needs ``_ts`` in the state."""
    return state.filter(F.col("_ts") > now - F.make_dt_interval(secs=F.lit(seconds)))


def merge_partial(changelog: DataFrame, keys: list[str], fields: str = "_fields") -> DataFrame:
    """State from full and partial publishes.

    ``fields`` is a map<string,string> of the supplied fields: an absent key keeps the old value, an explicit null
    overwrites. A full publish or a delete starts a new epoch; a partial publish after a delete re-creates the row.
    Two aggregations on one key: the second reuses the first one's partitioning.
    """
    return fold_fields(changelog, keys, fields, None)


def fold_fields(changelog: DataFrame, keys: list[str], fields: str, names: list[str] | None) -> DataFrame:
    """merge_partial, with columns ``names`` instead of a map if given."""
    epoch = changelog.groupBy(*keys).agg(F.max(F.when(F.col("_op").isin("U", "D"), F.col("_seq"))).alias("_epoch"))
    kept = changelog.join(epoch, keys).filter((F.col("_op") != "D") & (F.col("_seq") >= F.coalesce("_epoch", F.lit(-1))))
    if names is None:
        each = kept.select(*keys, "_seq", F.explode_outer(fields).alias("_k", "_v"))
        last = each.groupBy(*keys, "_k").agg(F.max_by("_v", "_seq").alias("_v"))
        return last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_k").isNotNull(), F.struct("_k", "_v"))))).alias("fields"))
    supplied = lambda n: F.map_contains_key(F.col(fields), n)
    return kept.groupBy(*keys).agg(*[F.max_by(F.when(supplied(n), F.struct(F.col(fields)[n].alias("v"))), F.when(supplied(n), F.col("_seq"))).getField("v").alias(n) for n in names])
