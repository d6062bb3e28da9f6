"""Topics, views and the engine that answers SQL over them."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.snapshot import as_of_seq, as_of_ts, expire, latest_by_key
from tidewright.plans import guardrails
from tidewright.plans.dialect import rewrite
from tidewright.sources import changelog as logs

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def plain_name(name: str) -> str:
    """``/positions`` and ``positions`` are one topic; the view name has no slash."""
    return name.lstrip("/").replace("-", "_").replace("/", "_")


@dataclass
class TopicDef:
    """A keyed topic. ``data`` is a state table, or a changelog if ``changelog`` is set, or ``path`` a changelog's folder, to
    which ``Engine.publish`` and ``Engine.delete`` append. ``row_filter`` holds for every way to read it."""

    name: str
    keys: tuple[str, ...] = ()
    data: DataFrame | None = None
    changelog: DataFrame | None = None
    expire_seconds: int | None = None
    row_filter: str | None = None
    path: str | None = None


@dataclass
class ViewDef:
    """A materialised aggregate over topics or other views."""

    name: str
    sql: str
    keys: tuple[str, ...]
    sources: tuple[str, ...]


@dataclass
class Engine:
    """Registers topics as temp views and answers the dialect over them.

    Row filters and expiry wrap the source before anything reads it, so they hold for SQL, snapshots, as-of states and keys.
    """

    spark: SparkSession
    topics: dict[str, TopicDef] = field(default_factory=dict)
    views: dict[str, ViewDef] = field(default_factory=dict)
    limits: guardrails.Limits = field(default_factory=guardrails.Limits)
    budgets: dict[str, guardrails.Limits] = field(default_factory=dict)
    prefix: str = ""  # of the names of its temp views
    _cached: dict[str, tuple[float, DataFrame]] = field(default_factory=dict)

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> Engine:
        engine = cls(spark)
        for t in tables or TABLES:
            engine.register(TopicDef(t, data=spark.read.parquet(f"{sf_dir}/{t}.parquet")))
        return engine

    def register(self, topic: TopicDef) -> TopicDef:
        name = plain_name(topic.name)
        if topic.path and topic.changelog is None:
            topic = replace(topic, changelog=logs.read(self.spark, topic.path))
        self.topics[name] = topic
        if topic.data is not None or topic.changelog is not None:
            self.sow(name).createOrReplaceTempView(self.prefix + name)
        self.invalidate()
        return topic

    def for_user(self, row_filters: dict[str, str], limits: guardrails.Limits | None = None) -> Engine:
        """An engine of one user, in which each named topic is under the user's row filter beside its own, and the tighter of both
        limits holds. Its SQL sees its own topics only; views are defined again over the filtered topics."""
        own = Engine(self.spark, limits=self.limits.tighter(limits) if limits else self.limits, prefix=f"u{uuid.uuid4().hex[:8]}_")
        filters = {plain_name(t): f for t, f in row_filters.items()}
        for name, t in self.topics.items():
            both = [f"({f})" for f in (t.row_filter, filters.get(name)) if f]
            own.register(replace(t, row_filter=" AND ".join(both) or None))
        for name in self.refresh_order():
            own.define_view(self.views[name])
        return own

    def entitled(self, topic: str, row_filter: str | Column) -> DataFrame:
        """The topic under one user's row filter."""
        return self.sow(topic).filter(row_filter)

    def _names(self) -> dict[str, str]:
        return {n: self.prefix + n for n in [*self.topics, *map(plain_name, self.views)]} if self.prefix else {}

    def _times(self) -> set[str]:
        return {c for t in self.topics.values() for d in (t.data, t.changelog) if d is not None for c, kind in d.dtypes if kind.startswith("timestamp")}

    def sql(self, text: str, user: str | None = None) -> DataFrame:
        """The answer to dialect SQL, refused before it runs if its estimate is over the limits, and failing while it runs if it
        has more rows than they allow."""
        limits = self.limits.tighter(self.budgets[user]) if user in self.budgets else self.limits
        df = rewrite(self.spark, text, limits.pivot_values or 10**6, self._times(), self._names())
        guardrails.preflight(df, limits)
        return guardrails.capped(df, limits.max_rows) if limits.max_rows else df

    def cached(self, text: str, seconds: float = 0.5, most: int = 16) -> DataFrame:
        """The same answer for all who ask within ``seconds``, until a topic changes; at most ``most`` answers are held, on disk
        where memory is short."""
        now = time.monotonic()
        for k, (at, df) in list(self._cached.items()):
            if now - at > seconds or (k not in (text,) and len(self._cached) >= most):
                df.unpersist()
                del self._cached[k]
        if text not in self._cached:
            self._cached[text] = now, self.sql(text).persist()
        return self._cached[text][1]

    def invalidate(self) -> None:
        for _, df in self._cached.values():
            df.unpersist()
        self._cached.clear()

    def sow(self, topic: str, *, seq: int | None = None, ts=None, now: Column | None = None) -> DataFrame:
        """Current state, or the state as of a sequence number or a timestamp, without expired rows (``now``: the time that counts
        for that, the query's by default), under the topic's row filter."""
        t = self.topics[plain_name(topic)]
        if t.changelog is None:
            df = t.data
        elif seq is not None:
            df = as_of_seq(t.changelog, list(t.keys), seq, keep_meta=True)
        elif ts is not None:
            df = as_of_ts(t.changelog, list(t.keys), ts, keep_meta=True)
        else:
            df = latest_by_key(t.changelog, list(t.keys), keep_meta=True)
        if t.changelog is not None:
            if t.expire_seconds:
                df = expire(df, now if now is not None else F.current_timestamp(), t.expire_seconds)
            df = df.drop("_seq", "_op", "_ts")
        return df.filter(t.row_filter) if t.row_filter else df

    def send_keys(self, topic: str) -> DataFrame:
        """Keys-only snapshot."""
        return self.sow(topic).select(*self.topics[plain_name(topic)].keys)

    def publish(self, topic: str, rows: DataFrame, op: str = "U") -> None:
        """Appends rows to the topic's log behind its last sequence number; its state is read anew afterwards."""
        t = self.topics[plain_name(topic)]
        last = t.changelog.agg(F.max("_seq")).first()[0] if t.changelog is not None else None
        self._append(t, logs.publish(rows, list(t.keys), -1 if last is None else last, op))

    def delete(self, topic: str, keys: DataFrame) -> None:
        """Appends tombstones."""
        t = self.topics[plain_name(topic)]
        last = t.changelog.agg(F.max("_seq")).first()[0]
        self._append(t, logs.delete(keys, list(t.keys), -1 if last is None else last))

    def _append(self, t: TopicDef, batch: DataFrame) -> None:
        logs.append(logs.aligned(batch, t.changelog) if t.changelog is not None else batch, t.path)
        self.register(replace(t, changelog=None))

    def select(self, topic: str, *, select: list[str] | None = None, where: str | None = None, order_by: list[tuple[str, bool]] | None = None, top_n: int | None = None, skip_n: int | None = None) -> DataFrame:
        """Builder form of a query: the options of a command without SQL text. order_by: (column, ascending)."""
        df = self.spark.table(self.prefix + plain_name(topic))
        df = df.filter(where) if where else df
        if order_by:
            df = df.orderBy(*[df[c].asc_nulls_first() if up else df[c].desc_nulls_last() for c, up in order_by])
        df = df.offset(skip_n) if skip_n else df
        df = df.limit(top_n) if top_n is not None else df
        return df.select(*select) if select else df

    def define_view(self, view: ViewDef) -> DataFrame:
        guardrails.check_view(view, self.topics, self.views, self.limits.view_depth)
        self.views[view.name] = view
        df = rewrite(self.spark, view.sql, self.limits.pivot_values or 10**6, self._times(), self._names())
        df.createOrReplaceTempView(self.prefix + plain_name(view.name))
        return df

    def refresh_order(self) -> list[str]:
        """Views with sources before dependants."""
        done: list[str] = []

        def visit(n: str) -> None:
            if n in self.views and n not in done:
                for s in self.views[n].sources:
                    visit(s)
                done.append(n)

        for n in self.views:
            visit(n)
        return done
