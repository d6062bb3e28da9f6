"""Append-only changelogs in Parquet: publish, delete, snapshot and recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.snapshot import latest_by_key


def as_changelog(df: DataFrame, seq: str, ts: str, deleted: Column | None = None) -> DataFrame:
    """An event table as a changelog."""
    op = F.when(deleted, "D").otherwise("U") if deleted is not None else F.lit("U")
    return df.select(F.col(seq).alias("_seq"), op.alias("_op"), F.col(ts).alias("_ts"), *[c for c in df.columns if c not in (seq, ts)])


def append(rows: DataFrame, path: str) -> None:
    """Appends a batch: publishes, partial publishes and deletes differ by _op. Spark's committer puts files in place when the job
    ends, so a failed batch leaves none; who lists the folder just then may see some of a batch's files."""
    rows.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A log with the columns of all its batches: tombstones have keys only, partial publishes some columns."""
    return spark.read.option("mergeSchema", True).parquet(path)


def aligned(batch: DataFrame, log: DataFrame) -> DataFrame:
    """A batch with the log's columns by their names and types, null where it has none, and its further ones behind them."""
    own = {c.lower(): c for c in batch.columns}
    known = [(F.col(f"`{own.pop(f.name.lower())}`") if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in log.schema]
    return batch.select(*known, *[f"`{c}`" for c in own.values()])


def publish(df: DataFrame, keys: list[str], last_seq: int, op: str = "U", order: list[str] | None = None) -> DataFrame:
    """Numbers a batch behind ``last_seq`` and refuses null keys. The numbers keep order within each partition and leave
    gaps between partitions: no global sort. With ``order`` the batch is range-sorted first."""
    for k in keys:
        df = df.withColumn(k, F.when(F.col(k).isNull(), F.raise_error(F.lit(f"null key {k}"))).otherwise(F.col(k)))
    df = df.orderBy(*order) if order else df
    return df.select((F.monotonically_increasing_id() + F.lit(last_seq + 1)).alias("_seq"), F.lit(op).alias("_op"), F.current_timestamp().alias("_ts"), *df.columns)


def delete(keys_frame: DataFrame, keys: list[str], last_seq: int) -> DataFrame:
    """Tombstones for the given keys."""
    return publish(keys_frame.select(*keys), keys, last_seq, "D")


def replicate(changelog: DataFrame, column: str | None = None, value: str | None = None, drop: list[str] | None = None) -> DataFrame:
    """What a standby gets: rows with column = value, tombstones always, without the dropped columns."""
    if column:
        changelog = changelog.filter((F.col("_op") == "D") | (F.col(column).cast("string") == value))
    return changelog.drop(*(drop or []))


def write_snapshot(changelog: DataFrame, keys: list[str], path: str) -> None:
    """State with its sequence numbers; the highest one is the water mark."""
    latest_by_key(changelog, keys, keep_meta=True).write.mode("overwrite").parquet(path)


def recover(spark: SparkSession, snapshot: str, log: str, keys: list[str]) -> DataFrame:
    """State from a snapshot and the log behind its water mark. The mark is one number, read first, so that the log's files are
    pruned by it. A key deleted behind the mark is gone; one deleted before it isn't in the snapshot."""
    snap = spark.read.parquet(snapshot)
    mark = snap.agg(F.max("_seq")).first()[0]
    tail = read(spark, log).filter(F.col("_seq") > (-1 if mark is None else mark))
    return latest_by_key(snap.unionByName(tail, allowMissingColumns=True), keys)


def compact(changelog: DataFrame, keys: list[str], path: str) -> None:
    """A log with one row a key, deletes gone."""
    latest_by_key(changelog, keys, keep_meta=True).write.mode("overwrite").parquet(path)
