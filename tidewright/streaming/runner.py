"""Continuous queries over a changelog stream.

Each micro-batch touches some keys. The state lives in a table of fixed hash buckets; a batch writes new versions of the buckets
it touches and a manifest that names the version of every bucket, so a batch reads one manifest and the buckets it needs, never a
listing of the past, and a replayed batch writes the same versions again (exactly-once with idempotent sinks). Versions that
neither of the last two manifests names are deleted. Order within a batch is by ``_seq``, never by arrival.

Aggregates are kept as partials per group, themselves a state table: what a batch adds to and takes from its rows is aggregated
and added to the groups it touches, so a batch costs what it touches and not what the state holds. The best rows of a top-n are
kept per bucket.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.deltas import classify, topn_deltas
from tidewright.operators.snapshot import META, latest_by_key
from tidewright.plans.guardrails import GuardrailError

_META = [T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_ts", T.TimestampNTZType())]


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[f"_k_{k}"]) for k in keys], F.lit(True))


def _only(rows: DataFrame, keys_of: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys, nulls included, occur in the other frame."""
    return rows.join(w := keys_of.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct(), _same(rows, w, keys), "left_semi")


@dataclass
class StateTable:
    """Latest row per key in ``path``/version=V/bucket=B, with ``path``/manifest=N for each batch N. Rows not written for
    ``expire_seconds`` of event time are deleted by the batch that finds them so."""

    spark: SparkSession
    path: str
    keys: list[str]
    schema: T.StructType
    buckets: int = 64
    expire_seconds: int | None = None
    _manifests: dict[int, dict[int, tuple[int, datetime | None]]] = field(default_factory=dict)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def manifest(self, batch_id: int) -> dict[int, tuple[int, datetime | None]]:
        """Bucket -> (version, oldest live row) after a batch: at most ``buckets`` entries, and -1 for the event time reached."""
        if batch_id not in self._manifests:
            try:
                rows = self.spark.read.parquet(f"{self.path}/manifest={batch_id}").collect()
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                rows = []  # before the first batch
            self._manifests[batch_id] = {r["b"]: (r["v"], r["oldest"]) for r in rows}
        return self._manifests[batch_id]

    def _put(self, batch_id: int, manifest: dict[int, tuple[int, datetime | None]]) -> None:
        rows = self.spark.createDataFrame([(b, v, t) for b, (v, t) in manifest.items()], "b int, v long, oldest timestamp_ntz")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={batch_id}")
        self._manifests = {batch_id: manifest, batch_id - 1: self._manifests.get(batch_id - 1, {})}

    def _files(self, versions: dict[int, int], part: str = "version") -> DataFrame:
        paths = [f"{self.path}/{part}={v}/bucket={b}" for b, v in versions.items() if b >= 0]
        full = T.StructType([*self.schema.fields, T.StructField("_changed", T.BooleanType())])
        return self.spark.read.schema(full).parquet(*paths) if paths else self.spark.createDataFrame([], full)

    def read(self, upto: int, only: list[int] | None = None, tombstones: bool = False) -> DataFrame:
        """Rows live after batch ``upto``, of the wanted buckets. Deletes stay stored with their sequence number, so an older row
        that arrives late does not come back."""
        df = self._files({b: v for b, (v, _) in self.manifest(upto).items() if only is None or b in only}).drop("_changed")
        return df if tombstones else df.filter("_op <> 'D'")

    def merge(self, batch: DataFrame, batch_id: int, top: tuple[list[Column], int] | None = None) -> tuple[DataFrame, DataFrame]:
        """Applies a batch; the rows that it changed, as they were and as they are (deletes stay out of both). ``top``: order and
        number of the rows to keep as each bucket's best."""
        old = dict(self.manifest(batch_id - 1))
        seen = batch.groupBy(self.bucket().alias("b")).agg(F.max("_ts").alias("t")).collect()  # at most ``buckets`` rows
        reached = max([t for t in [old.pop(-1, (0, None))[1], *(r["t"] for r in seen)] if t is not None], default=None)
        limit = reached - timedelta(seconds=self.expire_seconds) if self.expire_seconds and reached else None
        touched = sorted({r["b"] for r in seen} | {b for b, (_, t) in old.items() if limit and t and t <= limit})
        stored = self.read(batch_id - 1, touched, tombstones=True)
        cols = [f.name for f in self.schema.fields]
        rows = stored.select(*cols, F.lit(False).alias("_changed")).unionByName(batch.select(*cols, F.lit(True).alias("_changed")))
        after = latest_by_key(rows, self.keys, keep_meta=True, tombstones=True)
        if limit:
            dead = (F.col("_op") != "D") & (F.col("_ts") <= F.lit(limit).cast("timestamp_ntz"))
            after = after.withColumn("_dead", dead).withColumn("_changed", F.col("_changed") | F.col("_dead")).withColumn("_op", F.when(F.col("_dead"), "D").otherwise(F.col("_op")))
        here = f"{self.path}/version={batch_id}"
        if touched:
            after.select(*cols, "_changed", self.bucket().alias("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(here)
        written = self._files({b: batch_id for b in touched})
        oldest = {}
        if self.expire_seconds and touched:
            oldest = {r["b"]: r["t"] for r in written.filter("_op <> 'D'").groupBy(self.bucket().alias("b")).agg(F.min("_ts").alias("t")).collect()}
        if top and touched:
            best = written.filter("_op <> 'D'").withColumn("bucket", self.bucket()).withColumn("_rank", F.row_number().over(Window.partitionBy("bucket").orderBy(*top[0])))
            best.filter(F.col("_rank") <= top[1]).drop("_rank").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/top={batch_id}")
        self._vacuum(batch_id)
        self._put(batch_id, old | {b: (batch_id, oldest.get(b)) for b in touched} | {-1: (batch_id, reached)})
        changed = written.filter("_changed").drop("_changed")
        return _only(stored.filter("_op <> 'D'"), changed, self.keys), changed.filter("_op <> 'D'")

    def best(self, upto: int) -> DataFrame:
        """The best rows of every bucket: at most ``buckets`` times as many as the top has."""
        return self._existing({b: v for b, (v, _) in self.manifest(upto).items() if b >= 0})

    def _existing(self, versions: dict[int, int]) -> DataFrame:
        """Buckets whose rows are all deleted have no file of best rows."""
        df = None
        for v in sorted(set(versions.values())):
            try:
                part = self.spark.read.parquet(f"{self.path}/top={v}")
            except Exception as e:
                if "UNABLE_TO_INFER_SCHEMA" not in str(e) and "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            part = part.filter(F.col("bucket").isin([b for b, x in versions.items() if x == v])).drop("bucket", "_changed")
            df = part if df is None else df.unionByName(part)
        return df if df is not None else self.spark.createDataFrame([], self.schema)

    def _vacuum(self, batch_id: int) -> None:
        """Deletes what batch ``batch_id`` no longer needs for its replay: versions that only the manifest before the last names."""
        before, last = self._manifests.get(batch_id - 2), self.manifest(batch_id - 1)
        if not before:
            return
        store, base = fs.FileSystem.from_uri(self.path)
        for b, (v, _) in before.items():
            if b >= 0 and last.get(b, (v,))[0] != v:
                for kind in ("version", "top"):
                    where = f"{base}/{kind}={v}/bucket={b}"
                    if store.get_file_info(where).type == fs.FileType.Directory:
                        store.delete_dir(where)
        if store.get_file_info(f"{base}/manifest={batch_id - 3}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/manifest={batch_id - 3}")


@dataclass
class Measure:
    """An aggregate that can be added to and taken from: count, sum or avg of an expression."""

    alias: str
    kind: str
    of: Column

    def partials(self, weight: Column) -> list[Column]:
        x = self.of.cast("double") if self.kind == "avg" else self.of
        n = F.sum(F.when(x.isNotNull(), weight).otherwise(0)).alias(f"{self.alias}__n")
        return [n] if self.kind == "count" else [n, F.sum(F.coalesce(x, F.lit(0)) * weight).alias(f"{self.alias}__s")]

    def value(self) -> Column:
        n, s = F.col(f"{self.alias}__n"), F.col(f"{self.alias}__s") if self.kind != "count" else None
        return (n if self.kind == "count" else F.when(n > 0, s if self.kind == "sum" else s / n)).alias(self.alias)


@dataclass
class GroupView:
    """A materialised aggregate: partials per group in a state table of their own. ``having``: a condition on the result."""

    spark: SparkSession
    path: str
    groups: list[str]
    measures: list[Measure]
    having: str | None = None
    buckets: int = 16
    table: StateTable | None = None

    def apply(self, added: DataFrame, taken: DataFrame, batch_id: int) -> DataFrame:
        """Adds rows to and takes rows from the view; its deltas. Sums of doubles are added and taken too, so they can differ from
        a new sum in the last digits."""
        return self.shift(added.withColumn("_w", F.lit(1)).unionByName(taken.withColumn("_w", F.lit(-1))), batch_id)

    def shift(self, signed: DataFrame, batch_id: int) -> DataFrame:
        """The same for rows with their weight in _w."""
        w = F.col("_w")
        d = signed.groupBy(*self.groups).agg(F.sum("_w").alias("_n"), *[p for m in self.measures for p in m.partials(w)])
        parts = [c for c in d.columns if c not in self.groups]
        if self.table is None:
            self.table = StateTable(self.spark, self.path, self.groups, T.StructType([*d.schema.fields, *_META]), self.buckets)
        old = self.table.read(batch_id - 1).select(*[F.col(g).alias(f"_k_{g}") for g in self.groups], *[F.col(p).alias(f"_o_{p}") for p in parts])
        new = d.join(old, _same(d, old, self.groups), "left").select(*self.groups, *[(d[p] + F.coalesce(F.col(f"_o_{p}"), F.lit(0))).cast(d.schema[p].dataType).alias(p) for p in parts])
        op = F.when(F.col("_n") > 0, "U").otherwise("D")
        rows = new.select("*", F.lit(batch_id).cast("long").alias("_seq"), op.alias("_op"), F.lit(None).cast("timestamp_ntz").alias("_ts"))
        before, after = self.table.merge(rows, batch_id)
        return classify(self.shown(before), self.shown(after), self.groups)

    def shown(self, partials: DataFrame) -> DataFrame:
        out = partials.select(*self.groups, *[m.value() for m in self.measures])
        return out.filter(self.having) if self.having else out

    def read(self, upto: int) -> DataFrame:
        """The view after a batch: as many rows as groups, whatever the number of batches."""
        return self.shown(self.table.read(upto))


@dataclass
class ContinuousQuery:
    """Snapshot and then deltas of a filter, an aggregate or a top-n over one topic.

    kind: 'filter' (where; at most ``most`` matching rows, 0: any number), 'aggregate' (view, over rows that ``where`` keeps) or
    'topn' (order, n). Deltas of batch b are written under ``out``/batch=b, overwritten on replay.
    """

    table: StateTable
    out: str
    kind: str = "filter"
    where: str | None = None
    view: GroupView | None = None
    order: list = field(default_factory=list)
    n: int = 0
    most: int = 0
    active: int | None = None
    last: int = -1

    def seed(self, snapshot: DataFrame) -> DataFrame:
        """Starts from a state with its sequence numbers; what a subscriber gets first, written beside the state, whose first
        version goes as batches come."""
        rows = self.table.merge(snapshot, -1)[1]
        if self.kind == "aggregate":
            self.view.apply(self._kept(rows), self._kept(rows).limit(0), -1)
        first = self.view.read(-1) if self.kind == "aggregate" else self._kept(rows).drop(*META)
        path = f"{self.table.path}/snapshot"
        first.write.mode("overwrite").parquet(path)
        return self.table.spark.read.schema(first.schema).parquet(path)

    def _kept(self, rows: DataFrame) -> DataFrame:
        return rows.filter(F.coalesce(F.expr(self.where), F.lit(False))) if self.where else rows

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        t = self.table
        batch = batch.persist()
        try:
            before, after = t.merge(batch, batch_id, (self.order, self.n) if self.kind == "topn" else None)
            if self.kind == "filter":
                deltas = classify(before.drop(*META), after.drop(*META), t.keys, self.where, touched=True)
            elif self.kind == "topn":
                deltas = topn_deltas(t.best(batch_id - 1).drop(*META), t.best(batch_id).drop(*META), t.keys, self.order, self.n, after.select(*t.keys))
            else:
                deltas = self.view.apply(self._kept(after), self._kept(before), batch_id)
            deltas.write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
            self.last = batch_id
            if self.most and self.kind == "filter":
                self._guard(batch_id)
        finally:
            batch.unpersist()

    def _guard(self, batch_id: int) -> None:
        """Closes the subscription when more rows match than it may hold."""
        if self.active is None:
            self.active = self._kept(self.table.read(batch_id)).count()
        else:
            kinds = dict(self.table.spark.read.parquet(f"{self.out}/batch={batch_id}").groupBy("_delta").count().collect())
            self.active += kinds.get("add", 0) - kinds.get("oof", 0) - kinds.get("remove", 0)
        if self.active > self.most:
            raise GuardrailError(f"too many matches: {self.active}, at most {self.most}")

    def start(self, stream: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Runs until stopped; the trigger interval is the conflation interval. A restart resumes from the checkpoint."""
        return stream.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


@dataclass
class JoinedView:
    """A materialised aggregate over two topics joined on equal columns, kept up when either changes.

    The stream holds both changelogs, told apart by _side ('left' or 'right'); columns that a side lacks are null there, and the
    sides' columns differ in name. What joins anew is the left side's changes with the right side as it is, and the right side's changes with the left as it was.
    """

    left: StateTable
    right: StateTable
    on: list[tuple[str, Column]]  # (right column, expression over the left side)
    view: GroupView
    out: str
    last: int = -1

    def _joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        rows = left.drop(*META).select("*", *[e.alias(f"_on{i}") for i, (_, e) in enumerate(self.on)])
        return rows.join(right.drop(*META), [F.col(f"_on{i}") == F.col(c) for i, (c, _) in enumerate(self.on)])

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            signed = lambda b, a: a.withColumn("_w", F.lit(1)).unionByName(b.withColumn("_w", F.lit(-1)))
            was = self.left.read(batch_id - 1)
            mine, theirs = (signed(*t.merge(batch.filter(F.col("_side") == s).select(*t.schema.fieldNames()), batch_id)) for t, s in ((self.left, "left"), (self.right, "right")))
            rows = self._joined(mine, self.right.read(batch_id)).unionByName(self._joined(was, theirs), allowMissingColumns=True)
            self.view.shift(rows, batch_id).write.mode("overwrite").parquet(f"{self.out}/batch={batch_id}")
            self.last = batch_id
        finally:
            batch.unpersist()

    start = ContinuousQuery.start


def changelog_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def snapshot_and_subscribe(changelog: DataFrame, stream: DataFrame, keys: list[str], seq: int, query: ContinuousQuery) -> tuple[DataFrame, DataFrame]:
    """What the query holds at one cut, which also seeds it, and the stream strictly behind the cut: no row is missed or seen
    twice."""
    state = latest_by_key(changelog.filter(F.col("_seq") <= seq), keys, keep_meta=True, tombstones=True)
    return query.seed(state), stream.filter(F.col("_seq") > seq)
