"""Streams run to their end: the changelog of ``events`` fed in pieces, the last state compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import deltas
from tidewright.queries.batch import KEY, _cut, _state_sql, log_of
from tidewright.session import work_dir
from tidewright.sources.changelog import as_changelog
from tidewright.streaming.runner import ContinuousQuery, GroupView, JoinedView, Measure, StateTable, changelog_stream, snapshot_and_subscribe

QUERIES: dict = {}
ORACLE: dict = {}


def _log(spark: SparkSession, sf: str, base: str) -> DataFrame:
    log = log_of(spark, sf)
    log.repartitionByRange(4, "_seq").write.parquet(f"{base}/log")
    return log


def _run(spark: SparkSession, sf: str, view: list[Measure] | None = None, groups: tuple = ("event_type",), expire: int | None = None, **query) -> tuple[ContinuousQuery, DataFrame]:
    base = work_dir(spark)
    log = _log(spark, sf, base)
    table = StateTable(spark, f"{base}/state", KEY, log.schema, buckets=8, expire_seconds=expire)
    q = ContinuousQuery(table, f"{base}/out", view=GroupView(spark, f"{base}/view", list(groups), view, buckets=4) if view else None, **query)
    q.start(changelog_stream(spark, f"{base}/log", log.schema, files_per_trigger=2), f"{base}/checkpoint").awaitTermination()
    return q, spark.read.parquet(f"{base}/out")


def _folded(d: DataFrame) -> DataFrame:
    """What is in a query's result after its last batch, from the deltas alone."""
    last = d.groupBy(*KEY).agg(F.max_by(F.struct("_delta", "value"), "batch").alias("r"))
    return last.filter("r._delta IN ('add', 'update')").select(*KEY, "r.value")


def stream_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _folded(_run(spark, sf, kind="filter", where="value > 50")[1])


def stream_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Rows leave when nothing has written them for ten hours of event time."""
    return _folded(_run(spark, sf, kind="filter", where="value > 50", expire=36000)[1])


def stream_view(spark: SparkSession, sf: str) -> DataFrame:
    """A materialised view kept up by what each batch adds and takes."""
    q, _ = _run(spark, sf, kind="aggregate", view=[Measure("n", "count", F.lit(1)), Measure("total", "sum", F.col("value")), Measure("mean", "avg", F.col("value"))])
    return q.view.read(q.last).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def stream_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The continuous top 10, folded from its deltas."""
    return _folded(_run(spark, sf, kind="topn", order=[F.col("value").desc_nulls_last(), F.col("user_id")], n=10)[1])


def stream_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """A pivot kept up per anchor: a measure for each value that is spread."""
    high = F.col("value") > 50
    q, _ = _run(spark, sf, kind="aggregate", view=[Measure("hi", "count", F.when(high, 1)), Measure("lo", "count", F.when(~F.coalesce(high, F.lit(False)), 1))])
    return q.view.read(q.last)


def stream_join_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view over two topics, of which both change: nations move to another region half-way."""
    base = work_dir(spark)
    log, cut = log_of(spark, sf), _cut(spark, sf)
    nation = spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", "n_regionkey")
    moved = nation.filter("n_nationkey % 3 = 0").select("n_nationkey", (F.col("n_regionkey") + 10).alias("n_regionkey"))
    right = as_changelog(nation.withColumn("at", F.lit(-1)).unionByName(moved.withColumn("at", F.lit(cut))).select("*", F.lit(None).cast("timestamp_ntz").alias("t")), "at", "t")
    right = right.withColumn("_seq", F.col("_seq").cast("long"))
    both = log.withColumn("_side", F.lit("left")).unionByName(right.withColumn("_side", F.lit("right")), allowMissingColumns=True)
    both.repartitionByRange(4, "_seq").write.parquet(f"{base}/log")
    v = GroupView(spark, f"{base}/view", ["event_type"], [Measure("n", "count", F.lit(1)), Measure("regions", "sum", F.col("n_regionkey"))], buckets=4)
    q = JoinedView(StateTable(spark, f"{base}/left", KEY, log.schema, buckets=8), StateTable(spark, f"{base}/right", ["n_nationkey"], right.schema, buckets=2), [("n_nationkey", F.col("user_id") % 25)], v, f"{base}/out")
    q.start(changelog_stream(spark, f"{base}/log", both.schema, files_per_trigger=2), f"{base}/checkpoint").awaitTermination()
    return v.read(q.last)


def stream_sow_and_subscribe(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot at a cut and the deltas strictly behind it: together the filter's state of now."""
    base = work_dir(spark)
    log = _log(spark, sf, base)
    q = ContinuousQuery(StateTable(spark, f"{base}/state", KEY, log.schema, buckets=8), f"{base}/out", where="value > 50")
    snap, stream = snapshot_and_subscribe(log, changelog_stream(spark, f"{base}/log", log.schema, files_per_trigger=2), KEY, _cut(spark, sf), q)
    snap = snap.select(*KEY, "value")
    q.start(stream, f"{base}/checkpoint").awaitTermination()
    d = spark.read.parquet(f"{base}/out")
    last = d.groupBy(*KEY).agg(F.max_by(F.struct("_delta", "value"), "batch").alias("r")).select("r._delta", *KEY, "r.value")
    return deltas.apply_deltas(snap, last, KEY)


def stream_bookmark(spark: SparkSession, sf: str) -> DataFrame:
    """Pause and resume: the stream stops after half of the log, a new query object goes on from the checkpoint."""
    base = work_dir(spark)
    log = log_of(spark, sf)
    cut = _cut(spark, sf)
    view = lambda: GroupView(spark, f"{base}/view", ["event_type"], [Measure("n", "count", F.lit(1))], buckets=4)
    for part in (log.filter(F.col("_seq") <= cut), log.filter(F.col("_seq") > cut)):
        part.coalesce(2).write.mode("append").parquet(f"{base}/log")
        q = ContinuousQuery(StateTable(spark, f"{base}/state", KEY, log.schema, buckets=8), f"{base}/out", kind="aggregate", view=view())
        q.start(changelog_stream(spark, f"{base}/log", log.schema), f"{base}/checkpoint").awaitTermination()
    return q.view.read(q.last)


QUERIES |= {f.__name__: f for f in (stream_pivot, stream_join_view, stream_filter, stream_ttl, stream_view, stream_topn, stream_sow_and_subscribe, stream_bookmark)}
_NOW = _state_sql("true")
ORACLE |= {
    "stream_pivot": f"SELECT event_type, count(CASE WHEN value > 50 THEN 1 END) AS hi, count(CASE WHEN value > 50 THEN NULL ELSE 1 END) AS lo FROM {_NOW} GROUP BY event_type",
    "stream_join_view": f"SELECT event_type, count(*) AS n, CAST(sum(n_regionkey + CASE WHEN n_nationkey % 3 = 0 THEN 10 ELSE 0 END) AS BIGINT) AS regions FROM {_NOW} s JOIN nation ON s.user_id % 25 = n_nationkey GROUP BY event_type",
    "stream_filter": f"SELECT user_id, value FROM {_NOW} WHERE value > 50",
    "stream_ttl": f"SELECT user_id, value FROM {_NOW} WHERE value > 50 AND ts > (SELECT max(ts) FROM events) - INTERVAL 36000 SECOND",
    "stream_view": f"SELECT event_type, count(*) AS n, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM {_NOW} GROUP BY event_type",
    "stream_topn": f"SELECT user_id, value FROM {_NOW} ORDER BY value DESC NULLS LAST, user_id LIMIT 10",
    "stream_sow_and_subscribe": f"SELECT user_id, value FROM {_NOW} WHERE value > 50",
    "stream_bookmark": f"SELECT event_type, count(*) AS n FROM {_NOW} GROUP BY event_type",
}
