"""One query per operator over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.catalog import Engine, TopicDef
from tidewright.functions import scalar as S
from tidewright.operators import deltas as D
from tidewright.operators import joins, reshape, snapshot, windows
from tidewright.sources import changelog as C
from tidewright.session import work_dir
from tidewright.sources import binary, codecs, ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def dialect(name: str, text: str, oracle: str | None = None, tables: str = "") -> None:
    """A query written in the dialect; the oracle is the same text unless DuckDB needs another."""
    names = tables.split() or None

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Engine.over(spark, sf_dir, names).sql(text)

    QUERIES[name], ORACLE[name] = run, oracle or text


def query(name: str, oracle: str | None):
    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return put


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- filters
dialect("exposure_rollup", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS net, COUNT(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus", "lineitem")
dialect("scan_full", "SELECT * FROM nation", tables="nation")
dialect("filter_3vl_numeric", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT (NULLIF(l_discount, 0.0) > 0.05) OR NULLIF(l_tax, 0.0) IS NULL", tables="lineitem")
dialect("filter_long_int", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 AND p_size <> 20 AND p_partkey <> p_size", tables="part")
dialect("filter_between", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount NOT BETWEEN 0.02 AND 0.06", tables="lineitem")
dialect("filter_in", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (1, 2, 3)", tables="orders")
dialect("filter_like", r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_%' AND p_type NOT LIKE 'ST%'", tables="part")
dialect("filter_regex", "SELECT c_custkey, c_name FROM customer WHERE MATCHES_REGEX(c_name, '[02468]$')", "SELECT c_custkey, c_name FROM customer WHERE regexp_matches(c_name, '[02468]$')", "customer")
dialect("filter_timestamp", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-12 00:00:00'", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12'", "events")
dialect("filter_is_null", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_discount, 0.0) IS NULL AND NULLIF(l_tax, 0.0) IS NOT NULL", tables="lineitem")
dialect("filter_is_true", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (NULLIF(l_discount, 0.0) > 0.05) IS NOT TRUE AND (l_tax > 0.02) IS TRUE", tables="lineitem")
dialect("filter_not_null_logic", "SELECT COUNT(*) AS n FROM lineitem WHERE NOT (NULLIF(l_discount, 0.0) = 0.05 AND l_tax > 0.01)", tables="lineitem")
dialect("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax AND l_extendedprice * l_tax < l_quantity * 40", tables="lineitem")
dialect("filter_length", "SELECT p_partkey FROM part WHERE CHAR_LENGTH(p_name) > 9", "SELECT p_partkey FROM part WHERE LENGTH(p_name) > 9", "part")
dialect("filter_coalesce", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE COALESCE(NULLIF(l_discount, 0.0), 0.5) > 0.4", tables="lineitem")


@query("filter_string_fns", "SELECT c_custkey, c_name FROM customer WHERE upper(c_mktsegment) = 'BUILDING' AND substr(c_name, 1, 4) = 'Cust' AND concat(c_name, '!') LIKE '%1!'")
def filter_string_fns(spark, sf):
    c = read(spark, sf, "customer")
    return c.filter(S.fold_eq(F.col("c_mktsegment"), "building") & (S.substr(F.col("c_name"), 0, 4) == "Cust") & S.concat(F.col("c_name"), F.lit(None), F.lit("!")).like("%1!")).select("c_custkey", "c_name")


@query("filter_now", "SELECT COUNT(*) AS n FROM events WHERE epoch_us(ts) < epoch_us(current_timestamp)")
def filter_now(spark, sf):
    return read(spark, sf, "events").filter(F.unix_micros(F.col("ts").cast("timestamp")) < S.now_micros()).agg(F.count(F.lit(1)).alias("n"))


# --- projection
@query("project_computed_softnull", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio, l_quantity - 1 AS q1, -l_quantity AS neg, abs(l_discount - l_tax) AS gap, round(l_extendedprice) AS r0, floor(l_extendedprice)::DOUBLE AS f0, ceil(l_extendedprice)::DOUBLE AS c0, coalesce(nullif(l_discount, 0.0), 9.0) AS co FROM lineitem")
def project_computed_softnull(spark, sf):
    q, d, t, p = (F.col(f"l_{c}") for c in ("quantity", "discount", "tax", "extendedprice"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.soft_div(t, d).alias("ratio"), S.soft_sub(q, F.lit(1)).alias("q1"), (-S.num(q)).alias("neg"), F.abs(d - t).alias("gap"), S.round_d(p).alias("r0"), S.floor_d(p).alias("f0"), S.ceil_d(p).alias("c0"), F.coalesce(F.nullif(d, F.lit(0.0)), F.lit(9.0)).alias("co"))


dialect("project_qualified", "SELECT o.o_orderkey AS k, o.o_totalprice AS price FROM /orders AS o WHERE o.o_orderstatus = 'O'", "SELECT o.o_orderkey AS k, o.o_totalprice AS price FROM orders AS o WHERE o.o_orderstatus = 'O'", "orders")


@query("project_options", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50")
def project_options(spark, sf):
    return Engine.over(spark, sf, ["orders"]).select("/orders", select=["o_orderkey", "o_totalprice"], where="o_orderstatus = 'F'", order_by=[("o_totalprice", False), ("o_orderkey", True)], top_n=50)


dialect("cte_filter", "WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F') SELECT o_orderkey, o_totalprice FROM f WHERE o_totalprice > 100000", tables="orders")
dialect("derived_table", "SELECT status, n FROM (SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY o_orderstatus) d WHERE n > 10", tables="orders")

# --- subqueries and joins
dialect("in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", tables="customer orders")


@query("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def not_in_subquery(spark, sf):
    return joins.in_values(read(spark, sf, "customer"), "c_custkey", read(spark, sf, "orders").filter("o_totalprice > 250000").select("o_custkey"), negate=True).select("c_custkey")


dialect("exists_fold", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < -1)", tables="nation orders")


def _co(spark, sf):
    c = read(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"), "c_name")
    o = read(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    return c, o


for _how, _word in (("inner", "JOIN"), ("left", "LEFT JOIN"), ("right", "RIGHT JOIN"), ("full", "FULL JOIN")):
    QUERIES[f"join_{_how}"] = lambda spark, sf, how=_how: joins.equi_join(*_co(spark, sf), ["custkey"], how)
    ORACLE[f"join_{_how}"] = f"SELECT custkey, c_name, o_orderkey, o_totalprice FROM (SELECT c_custkey AS custkey, c_name FROM customer WHERE c_acctbal > 0) {_word} (SELECT o_custkey AS custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000) USING (custkey)"


@query("join_multi_key", "SELECT a.pk, a.sk, a.q, b.q AS right_q FROM (SELECT l_partkey AS pk, l_suppkey AS sk, SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2) a JOIN (SELECT l_partkey AS pk, l_suppkey AS sk, SUM(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1, 2) b ON a.pk = b.pk AND a.sk = b.sk")
def join_multi_key(spark, sf):
    side = lambda flag: read(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk")).agg(F.sum("l_quantity").alias("q"))
    return joins.equi_join(side("R"), side("N"), ["pk", "sk"])


_ASOF = "SELECT a.user_id, a.ts, a.event_id, b.ts AS right_ts, b.px FROM (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase') a ASOF JOIN (SELECT user_id, ts, max(value) AS px FROM events WHERE event_type = 'view' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts >= b.ts"


def _asof_sides(spark, sf):
    e = read(spark, sf, "events")
    return e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("px"))


@query("asof_join_events", _ASOF)
def asof_join_events(spark, sf):
    return joins.asof_join(*_asof_sides(spark, sf), ["user_id"], "ts")


@query("asof_join_bucketed", _ASOF.replace("ASOF JOIN", "ASOF LEFT JOIN"))
def asof_join_bucketed(spark, sf):
    return joins.asof_join(*_asof_sides(spark, sf), ["user_id"], "ts", how="left", bucket="day")


@query("asof_join_sql", _ASOF)
def asof_join_sql(spark, sf):
    left, right = _asof_sides(spark, sf)
    left.createOrReplaceTempView("purchases")
    right.createOrReplaceTempView("quotes")
    return Engine(spark).sql("SELECT p.user_id, p.ts, p.event_id, q.ts AS right_ts, q.px FROM purchases p ASOF JOIN quotes q MATCH_CONDITION (p.ts >= q.ts) USING (user_id)")


# --- aggregates
dialect("agg_group", "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total, ROUND(AVG(o_totalprice), 4) AS mean, MIN(o_totalprice) AS low, MAX(o_orderdate) AS last FROM orders GROUP BY o_orderpriority, o_orderstatus", tables="orders")
dialect("agg_global_empty", "SELECT COUNT(*) AS n, SUM(o_totalprice) AS total, MIN(o_orderstatus) AS low FROM orders WHERE o_totalprice < -1", tables="orders")
dialect("agg_group_only", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority", tables="orders")
dialect("agg_count", "SELECT l_returnflag, COUNT(*) AS n, COUNT(NULLIF(l_discount, 0.0)) AS nonzero FROM lineitem GROUP BY l_returnflag", tables="lineitem")
dialect("agg_sum_long", "SELECT CAST(SUM(l_orderkey) AS BIGINT) AS s, MIN(l_linenumber) AS lo, MAX(l_linenumber) AS hi FROM lineitem", tables="lineitem")
dialect("agg_null_group", "SELECT NULLIF(l_discount, 0.0) AS d, COUNT(*) AS n FROM lineitem GROUP BY NULLIF(l_discount, 0.0)", tables="lineitem")
dialect("agg_count_distinct", "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS custs, COUNT(DISTINCT o_orderstatus) AS st FROM orders GROUP BY o_orderpriority", tables="orders")
dialect("agg_stddev_var", "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS sd, ROUND(STDDEV_SAMP(l_quantity), 6) AS sds, ROUND(VARIANCE(l_quantity), 6) AS va, ROUND(VAR_SAMP(l_quantity), 6) AS vas FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, ROUND(STDDEV_POP(l_quantity), 6) AS sd, ROUND(STDDEV_SAMP(l_quantity), 6) AS sds, ROUND(VAR_POP(l_quantity), 6) AS va, ROUND(VAR_SAMP(l_quantity), 6) AS vas FROM lineitem GROUP BY l_returnflag", "lineitem")
dialect("agg_percentile", "SELECT o_orderstatus, ROUND(PERCENTILE_CONT(o_totalprice, 0.25), 4) AS p25, ROUND(PERCENTILE_CONT(o_totalprice, 0.9), 4) AS p90, ROUND(MEDIAN(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, ROUND(quantile_cont(o_totalprice, 0.25), 4) AS p25, ROUND(quantile_cont(o_totalprice, 0.9), 4) AS p90, ROUND(median(o_totalprice), 4) AS med FROM orders GROUP BY o_orderstatus", "orders")
dialect("agg_expr", "SELECT l_shipdate, ROUND(SUM(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge FROM lineitem GROUP BY l_shipdate", tables="lineitem")
dialect("agg_vwap_nullif", "SELECT l_suppkey, ROUND(SUM(l_extendedprice * l_quantity) / NULLIF(SUM(l_quantity), 0), 4) AS vwap, ABS(ROUND(MIN(l_discount) - MAX(l_discount), 4)) AS spread FROM lineitem GROUP BY l_suppkey", tables="lineitem")
dialect("agg_having", "SELECT o_custkey, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND NOT (SUM(o_totalprice) < 100000)", tables="orders")
dialect("distinct_multi", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", tables="lineitem")


# --- windows
_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@query("win_rank", f"SELECT o_orderkey, row_number() {_W} AS rn, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS rk, dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS dr FROM orders")
def win_rank(spark, sf):
    by = ["o_orderdate", "o_orderkey"]
    return read(spark, sf, "orders").select("o_orderkey", windows.ranked("row_number", ["o_custkey"], by).alias("rn"), windows.ranked("rank", ["o_orderstatus"], ["o_orderpriority"]).alias("rk"), windows.ranked("dense_rank", ["o_orderstatus"], ["o_orderpriority"]).alias("dr"))


@query("win_lag_lead_ntile", f"SELECT o_orderkey, lag(o_totalprice) {_W} AS prev, lead(o_totalprice, 2, -1.0) {_W} AS nxt, ntile(3) {_W} AS tile FROM orders")
def win_lag_lead(spark, sf):
    by = (["o_custkey"], ["o_orderdate", "o_orderkey"])
    return read(spark, sf, "orders").select("o_orderkey", windows.ranked("lag", *by, "o_totalprice").alias("prev"), windows.ranked("lead", *by, "o_totalprice", 2, -1.0).alias("nxt"), windows.ranked("ntile", *by, 3).alias("tile"))


_R = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_U = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("win_rolling", f"SELECT o_orderkey, round(sum(o_totalprice) {_R}, 2) AS s3, round(avg(o_totalprice) {_R}, 4) AS a3, min(o_totalprice) {_R} AS m3, max(o_totalprice) {_R} AS x3, count(*) {_R} AS c3 FROM orders")
def win_rolling(spark, sf):
    by = (["o_custkey"], ["o_orderdate", "o_orderkey"], 2)
    f = lambda fn: windows.rolling(fn, "o_totalprice", *by)
    return read(spark, sf, "orders").select("o_orderkey", F.round(f("sum"), 2).alias("s3"), F.round(f("avg"), 4).alias("a3"), f("min").alias("m3"), f("max").alias("x3"), windows.rolling("count", "*", *by).alias("c3"))


@query("win_cumulative", f"SELECT o_orderkey, round(sum(o_totalprice) {_U}, 2) AS run, count(nullif(o_orderstatus, 'F')) {_U} AS open_n FROM orders")
def win_cumulative(spark, sf):
    by = (["o_custkey"], ["o_orderdate", "o_orderkey"])
    d = read(spark, sf, "orders").withColumn("st", F.nullif("o_orderstatus", F.lit("F")))
    return d.select("o_orderkey", F.round(windows.rolling("sum", "o_totalprice", *by), 2).alias("run"), windows.rolling("count", "st", *by).alias("open_n"))


# --- order and reshape
dialect("sort_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority, o_orderkey DESC LIMIT 5, 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderpriority NULLS FIRST, o_orderkey DESC NULLS LAST LIMIT 20 OFFSET 5", "orders")
dialect("top_n", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25", tables="customer")


@query("pivot_static", "SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS O FROM orders GROUP BY o_custkey")
def pivot_static(spark, sf):
    d = read(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return reshape.pivot(d, "o_orderstatus", ["F", "O"], {"n": ("count", "o_orderkey")})


@query("pivot_multi", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F_total, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F_n, round(sum(CASE WHEN o_orderstatus = 'X' THEN o_totalprice END), 2) AS X_total, count(CASE WHEN o_orderstatus = 'X' THEN 1 END) AS X_n FROM orders GROUP BY o_orderpriority")
def pivot_multi(spark, sf):
    p = reshape.pivot(read(spark, sf, "orders"), "o_orderstatus", ["F", "X"], {"total": ("sum", "o_totalprice"), "n": ("count", "*")}, ["o_orderpriority"])
    return p.withColumns({c: F.round(c, 2) for c in ("F_total", "X_total")})


@query("pivot_dynamic", "SELECT o_orderpriority, round(max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F, round(max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS O, round(max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS P FROM orders GROUP BY o_orderpriority")
def pivot_dynamic(spark, sf):
    return reshape.pivot_any(read(spark, sf, "orders"), "o_orderstatus", {"m": ("max", "o_totalprice")}, ["o_orderpriority"])


dialect("pivot_sql_any", "SELECT * FROM prio PIVOT (SUM(n) FOR st IN (ANY))", "SELECT prio, CAST(sum(CASE WHEN st = 'F' THEN 1 END) AS BIGINT) AS F, CAST(sum(CASE WHEN st = 'O' THEN 1 END) AS BIGINT) AS O, CAST(sum(CASE WHEN st = 'P' THEN 1 END) AS BIGINT) AS P FROM (SELECT o_orderpriority AS prio, o_orderstatus AS st FROM orders) GROUP BY prio")


def _pivot_sql_any(spark, sf):
    e = Engine.over(spark, sf, ["orders"])
    e.register(TopicDef("prio", data=read(spark, sf, "orders").select(F.col("o_orderpriority").alias("prio"), F.col("o_orderstatus").alias("st"), F.lit(1).cast("long").alias("n"))))
    return e.sql("SELECT * FROM prio PIVOT (SUM(n) FOR st IN (ANY))")


QUERIES["pivot_sql_any"] = _pivot_sql_any


@query("unpivot", "SELECT l_orderkey, l_linenumber, 'disc' AS kind, nullif(l_discount, 0.0) AS rate FROM lineitem WHERE nullif(l_discount, 0.0) IS NOT NULL UNION ALL SELECT l_orderkey, l_linenumber, 'tax', nullif(l_tax, 0.0) FROM lineitem WHERE nullif(l_tax, 0.0) IS NOT NULL")
def unpivot(spark, sf):
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("disc"), F.nullif("l_tax", F.lit(0.0)).alias("tax"))
    return reshape.unpivot(d, ["l_orderkey", "l_linenumber"], ["disc", "tax"], "kind", "rate")


dialect("set_ops", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0 EXCEPT SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", tables="orders customer")

# --- changelog and state; events keyed by user, 'error' deletes
KEY = ["user_id"]


def log_of(spark: SparkSession, sf: str) -> DataFrame:
    return C.as_changelog(read(spark, sf, "events"), "event_id", "ts", F.col("event_type") == "error")


def _state_sql(cond: str) -> str:
    return f"(SELECT * EXCLUDE (rn) FROM (SELECT user_id, event_type, value, props, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE {cond}) WHERE rn = 1 AND event_type <> 'error')"


_MID = "(SELECT max(event_id) // 2 FROM events)"


def _cut(spark, sf) -> int:
    """The sequence number that the two-state queries cut at: one scalar."""
    return read(spark, sf, "events").agg(F.max("event_id")).first()[0] // 2


@query("sow_latest", f"SELECT user_id, event_type, value, props FROM {_state_sql('true')}")
def sow_latest(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("/state", tuple(KEY), changelog=log_of(spark, sf)))
    return e.sow("state")


@query("sow_as_of_seq", f"SELECT user_id, event_type, value, props FROM {_state_sql(f'event_id <= {_MID}')}")
def sow_as_of_seq(spark, sf):
    return snapshot.as_of_seq(log_of(spark, sf), KEY, _cut(spark, sf))


_TS = "2024-01-15 00:00:00"


@query("sow_as_of_ts", f"SELECT user_id, event_type, value, props FROM {_state_sql(f'''ts <= TIMESTAMP '{_TS}' ''')}")
def sow_as_of_ts(spark, sf):
    return snapshot.as_of_ts(log_of(spark, sf), KEY, F.lit(_TS).cast("timestamp_ntz"))


@query("sow_ttl", f"SELECT user_id, event_type, value FROM {_state_sql('true')} WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 36000 SECOND")
def sow_ttl(spark, sf):
    now = read(spark, sf, "events").agg(F.max("ts")).first()[0]
    return snapshot.expire(snapshot.latest_by_key(log_of(spark, sf), KEY, keep_meta=True), F.lit(now).cast("timestamp_ntz"), 36000).select("user_id", "event_type", "value")


@query("sow_keys_only", f"SELECT user_id FROM {_state_sql('true')}")
def sow_keys_only(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("/state", tuple(KEY), changelog=log_of(spark, sf)))
    return e.send_keys("/state")


@query("replay_bookmark", f"SELECT event_id AS _seq, user_id, value FROM events WHERE event_id > {_MID}")
def replay_bookmark(spark, sf):
    return snapshot.replay_since(log_of(spark, sf), bookmark=_cut(spark, sf)).select("_seq", "user_id", "value")


@query("replay_since_ts", f"SELECT event_id AS _seq, user_id FROM events WHERE event_id > coalesce((SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '{_TS}'), -1)")
def replay_since_ts(spark, sf):
    return snapshot.replay_since(log_of(spark, sf), ts=F.lit(_TS).cast("timestamp_ntz")).select("_seq", "user_id")


_PART = """WITH l AS (SELECT event_id AS s, user_id, CASE WHEN event_type = 'error' THEN 'D' WHEN event_type = 'signup' THEN 'U' ELSE 'P' END AS op, event_type, value FROM events),
e AS (SELECT user_id, max(s) FILTER (WHERE op IN ('U', 'D')) AS ep FROM l GROUP BY 1),
k AS (SELECT l.* FROM l JOIN e USING (user_id) WHERE s >= coalesce(ep, -1) AND op <> 'D')
SELECT user_id, arg_max(CASE WHEN value < 20 THEN 'null!' ELSE CAST(event_type AS VARCHAR) END, s) FILTER (WHERE op = 'U' OR event_type <> 'click') AS kind,
max(s) AS last_s FROM k GROUP BY 1"""


@query("sow_partial_merge", f"SELECT user_id, nullif(kind, 'null!') AS kind, CAST(last_s AS VARCHAR) AS last_s FROM ({_PART})")
def sow_partial_merge(spark, sf):
    return snapshot.fold_fields(_partial_log(spark, sf), KEY, "_fields", ["kind", "last_s"])


def _partial_log(spark, sf):
    e = read(spark, sf, "events")
    op = F.when(F.col("event_type") == "error", "D").when(F.col("event_type") == "signup", "U").otherwise("P")
    kind = F.when(F.col("value") < 20, F.lit(None).cast("string")).otherwise(F.col("event_type"))
    base = F.create_map(F.lit("last_s"), F.col("event_id").cast("string"))
    fields = F.when((op == "U") | (F.col("event_type") != "click"), F.map_concat(base, F.create_map(F.lit("kind"), kind))).otherwise(base)
    return e.select(F.col("event_id").alias("_seq"), op.alias("_op"), F.col("ts").alias("_ts"), "user_id", fields.alias("_fields"))


@query("replicate_filter", "SELECT event_id AS _seq, user_id, event_type FROM events WHERE event_type = 'error' OR event_type = 'view'")
def replicate_filter(spark, sf):
    return C.replicate(log_of(spark, sf), "event_type", "view", ["props"]).select("_seq", "user_id", "event_type")


# --- deltas between two cuts
_S0, _S1 = _state_sql(f"event_id <= {_MID}"), _state_sql("true")


def _states(spark, sf):
    """The states as of the cut and of now, from one shuffle of the log."""
    return snapshot.split_states(snapshot.two_states(log_of(spark, sf), KEY, _cut(spark, sf)), KEY)


_CLASS = f"SELECT CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' WHEN was AND alive THEN 'oof' ELSE 'remove' END AS _delta, user_id, CASE WHEN now THEN v1 ELSE v0 END AS value FROM (SELECT user_id, a.value AS v0, b.value AS v1, coalesce(a.value > 50, false) AS was, coalesce(b.value > 50, false) AS now, b.event_id IS NOT NULL AS alive, a.event_id IS DISTINCT FROM b.event_id AS hit FROM {_S0} a FULL JOIN {_S1} b USING (user_id)) WHERE (was OR now) AND (hit OR NOT (was AND now))"


@query("delta_classify", _CLASS)
def delta_classify(spark, sf):
    return D.net(log_of(spark, sf), KEY, _cut(spark, sf), "value > 50").select("_delta", "user_id", "value")


@query("delta_apply", f"SELECT user_id, value FROM {_S1} WHERE value > 50")
def delta_apply(spark, sf):
    snap = snapshot.as_of_seq(log_of(spark, sf), KEY, _cut(spark, sf)).filter("value > 50").select("user_id", "value")
    return D.apply_deltas(snap, D.net(log_of(spark, sf), KEY, _cut(spark, sf), "value > 50").select("_delta", "user_id", "value"), KEY)


_SP0, _SP1 = (f"(SELECT user_id, event_type, round(value) AS v FROM {s})" for s in (_S0, _S1))


@query("delta_sparse", f"SELECT CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' WHEN was AND alive THEN 'oof' ELSE 'remove' END AS _delta, user_id, CASE WHEN now AND (NOT was OR e0 <> e1) THEN e1 END AS event_type, CASE WHEN now AND (NOT was OR v0 <> v1) THEN v1 END AS v FROM (SELECT user_id, a.v AS v0, b.v AS v1, a.event_type AS e0, b.event_type AS e1, coalesce(a.v > 50, false) AS was, coalesce(b.v > 50, false) AS now, b.v IS NOT NULL AS alive FROM {_SP0} a FULL JOIN {_SP1} b USING (user_id)) WHERE (was OR now) AND (NOT (was AND now) OR e0 <> e1 OR v0 <> v1)")
def delta_sparse(spark, sf):
    cut = lambda d: d.select("user_id", "event_type", F.round("value").alias("v"))
    a, b = _states(spark, sf)
    of = lambda f: F.get_json_object("_payload", f"$.{f}")
    return D.sparse(cut(a), cut(b), KEY, "v > 50").select("_delta", "user_id", of("event_type").alias("event_type"), of("v").cast("double").alias("v"))


_EV = "SELECT event_id AS _seq, CASE WHEN NOT was AND now THEN 'add' WHEN was AND now THEN 'update' WHEN was AND event_type = 'error' THEN 'remove' ELSE 'oof' END AS _delta, user_id, value FROM (SELECT *, coalesce(lag(now) OVER (PARTITION BY user_id ORDER BY event_id), false) AS was FROM (SELECT *, value > 50 AND event_type <> 'error' AS now FROM events)) WHERE was OR now"


@query("delta_per_event", _EV)
def delta_per_event(spark, sf):
    return D.per_event(log_of(spark, sf), KEY, "value > 50", ["value"])


@query("delta_conflated", f"SELECT _slot, _seq, CASE WHEN f = 'add' AND l IN ('add', 'update') THEN 'add' WHEN l IN ('add', 'update') THEN 'update' ELSE l END AS _delta, user_id, value FROM (SELECT user_id, _seq // 500 AS _slot, arg_min(_delta, _seq) AS f, arg_max(_delta, _seq) AS l, arg_max(value, _seq) AS value, max(_seq) AS _seq FROM ({_EV}) GROUP BY user_id, _seq // 500) WHERE NOT (f = 'add' AND l NOT IN ('add', 'update'))")
def delta_conflated(spark, sf):
    return D.conflate(D.per_event(log_of(spark, sf), KEY, "value > 50", ["value"]), KEY, 500)


_T0, _T1 = (f"(SELECT user_id, value FROM {s} ORDER BY value DESC NULLS LAST, user_id LIMIT 20)" for s in (_S0, _S1))


@query("delta_topn", f"SELECT CASE WHEN v0 IS NULL THEN 'add' WHEN v1 IS NOT NULL THEN 'update' WHEN user_id IN (SELECT user_id FROM {_S1}) THEN 'oof' ELSE 'remove' END AS _delta, user_id, coalesce(v1, v0) AS value FROM (SELECT user_id, a.value AS v0, b.value AS v1 FROM {_T0} a FULL JOIN {_T1} b USING (user_id)) WHERE v0 IS DISTINCT FROM v1")
def delta_topn(spark, sf):
    a, b = (d.select("user_id", "value") for d in _states(spark, sf))
    return D.topn_deltas(a, b, KEY, [F.col("value").desc_nulls_last(), F.col("user_id")], 20)


_G0, _G1 = (f"(SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM {s} GROUP BY 1 HAVING count(*) > 1)" for s in (_S0, _S1))


@query("delta_group", f"SELECT CASE WHEN n0 IS NULL THEN 'add' WHEN n1 IS NULL THEN 'remove' ELSE 'update' END AS _delta, event_type, coalesce(n1, n0) AS n, coalesce(t1, t0) AS total FROM (SELECT event_type, a.n AS n0, b.n AS n1, a.total AS t0, b.total AS t1 FROM {_G0} a FULL JOIN {_G1} b USING (event_type)) WHERE n0 IS DISTINCT FROM n1 OR t0 IS DISTINCT FROM t1")
def delta_group(spark, sf):
    g = lambda d: d.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).filter("n > 1")
    a, b = _states(spark, sf)
    return D.group_deltas(g(a), g(b), ["event_type"])


# --- ingest, entitlements, views, codecs
@query("nested_flatten_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def nested_flatten_props(spark, sf):
    e = read(spark, sf, "events").select("event_id", "props")
    return ingest.from_json_text(e, "props", T.StructType([T.StructField("k", T.LongType())]))


@query("coerce_types", "SELECT event_id, CAST(event_id % 2 = 0 AS BOOLEAN) AS flag, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS whole FROM events")
def coerce_types(spark, sf):
    raw = read(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("n").alias("flag"), F.when(F.col("value") == F.floor("value"), F.floor("value").cast("string")).otherwise(F.col("value").cast("string")).alias("whole"))
    return ingest.coerce(raw, T.StructType([T.StructField("event_id", T.LongType()), T.StructField("flag", T.BooleanType()), T.StructField("whole", T.LongType())]))


@query("entitlement_filter", "SELECT c_mktsegment, COUNT(*) AS n FROM customer WHERE c_nationkey < 10 GROUP BY c_mktsegment")
def entitlement_filter(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("customer", ("c_custkey",), data=read(spark, sf, "customer"), row_filter="c_nationkey < 10"))
    return e.sql("SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment")


@query("view_on_view", "SELECT n_regionkey, COUNT(*) AS nations, CAST(SUM(n) AS BIGINT) AS custs FROM (SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) GROUP BY n_regionkey")
def view_on_view(spark, sf):
    from tidewright.catalog import ViewDef

    e = Engine.over(spark, sf, ["customer", "nation"])
    e.define_view(ViewDef("by_nation", "SELECT n_regionkey, n_nationkey, COUNT(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_nationkey", ("n_nationkey",), ("customer", "nation")))
    return e.define_view(ViewDef("by_region", "SELECT n_regionkey, COUNT(*) AS nations, SUM(n) AS custs FROM by_nation GROUP BY n_regionkey", ("n_regionkey",), ("by_nation",)))


@query("codec_fix", "SELECT event_id, CAST(user_id AS VARCHAR) AS tag1, event_type AS tag35, '1=' || user_id || chr(1) || '35=' || event_type || chr(1) AS wire FROM events")
def codec_fix(spark, sf):
    e = read(spark, sf, "events")
    wire = codecs.format_fix(F.create_map(F.lit("35"), F.col("event_type"), F.lit("1"), F.col("user_id").cast("string")))
    m = codecs.parse_fix(F.col("wire"))
    return e.select("event_id", wire.alias("wire")).select("event_id", m["1"].alias("tag1"), m["35"].alias("tag35"), "wire")


@query("codec_json", """SELECT '{"event_id":' || event_id || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","event_type":"' || event_type || '","value":' || CASE WHEN value < 20 THEN 'null' ELSE CAST(CAST(round(value) AS BIGINT) AS VARCHAR) END || ',"key":"' || to_base64(encode(event_type)) || '"}' AS json FROM events""")
def codec_json(spark, sf):
    e = read(spark, sf, "events").select("event_id", "ts", "event_type", F.when(F.col("value") >= 20, F.round("value").cast("long")).alias("value"), F.encode("event_type", "utf-8").alias("key"))
    return codecs.to_json_rows(e)


@query("sow_batches", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json, true AS small FROM nation""")
def sow_batches(spark, sf):
    b = codecs.sow_batches(read(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), 10)
    return b.select(F.explode("rows").alias("json"), (F.size("rows") <= 10).alias("small"))


_ROW = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("odd", T.BooleanType())])


def _rows(spark, sf):
    """Events of all the codecs' types, to whole milliseconds."""
    return read(spark, sf, "events").select(F.when(F.col("user_id") % 5 > 0, F.col("event_id") * 99991 - 10**6).alias("event_id"), F.date_trunc("millisecond", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "value", (F.col("event_id") % 2 == 1).alias("odd"))


for _codec in ("msgpack", "bson"):
    QUERIES[f"codec_{_codec}"] = lambda spark, sf, codec=_codec: binary.decode_rows(binary.encode_rows(_rows(spark, sf), codec, zstd=codec == "bson"), codec, _ROW, zstd=codec == "bson")
    ORACLE[f"codec_{_codec}"] = "SELECT CASE WHEN user_id % 5 > 0 THEN event_id * 99991 - 1000000 END AS event_id, date_trunc('millisecond', ts) AS ts, event_type, value, event_id % 2 = 1 AS odd FROM events"


@query("codec_nvfix", "SELECT event_id, event_type AS kind, CAST(user_id AS VARCHAR) AS who FROM events")
def codec_nvfix(spark, sf):
    e = read(spark, sf, "events")
    m = codecs.parse_nvfix(F.col("wire"))
    return e.select("event_id", codecs.format_nvfix(F.create_map(F.lit("kind"), F.col("event_type"), F.lit("who"), F.col("user_id").cast("string"))).alias("wire")).select("event_id", m["kind"].alias("kind"), m["who"].alias("who"))


# --- the dialect's meanings, in its SQL
dialect("div_zero_sql", "SELECT l_orderkey, l_linenumber, l_tax / l_discount AS ratio, CAST(l_returnflag AS INT) AS none FROM lineitem WHERE l_quantity / l_discount > 900 OR l_discount / 0 IS NULL", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN l_tax / l_discount END AS ratio, CAST(NULL AS INTEGER) AS none FROM lineitem", "lineitem")
dialect("fold_sql", "SELECT c_custkey FROM customer WHERE UPPER(c_mktsegment) = 'building' OR LOWER(c_mktsegment) LIKE 'MACH%' OR 'Furniture' = UPPER(c_mktsegment)", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE')", "customer")
dialect("substr_concat_sql", "SELECT c_custkey, SUBSTR(c_name, -3, 4) AS head, CONCAT(c_mktsegment, NULL, '!') AS seg FROM customer WHERE SUBSTR(c_name, 0, 4) = 'Cust'", "SELECT c_custkey, substr(c_name, 1, 4) AS head, c_mktsegment || '!' AS seg FROM customer", "customer")
dialect("now_sql", "SELECT COUNT(*) AS n FROM nation WHERE NOW() > 1700000000000000", "SELECT COUNT(*) AS n FROM nation", "nation")
dialect("round_sql", "SELECT l_orderkey, l_linenumber, FLOOR(l_extendedprice) AS f, CEIL(l_extendedprice) AS c, ROUND(l_extendedprice) AS r, -ABS(l_quantity) AS q FROM lineitem", "SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice) AS DOUBLE) AS f, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, round(l_extendedprice) AS r, -abs(l_quantity) AS q FROM lineitem", "lineitem")
dialect("win_frame_sql", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey) AS c, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS m FROM orders", "SELECT o_orderkey, COUNT(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders", "orders")
dialect("sum_overflow_sql", "SELECT o_orderstatus, SUM(o_orderkey * 0 + 9000000000000000000) AS s FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(NULL AS BIGINT) AS s FROM orders GROUP BY o_orderstatus", "orders")
dialect("sort_alias_sql", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 30", tables="orders")
dialect("sort_expr_sql", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY ABS(o_totalprice - 200000), o_orderkey LIMIT 30", tables="orders")
dialect("time_literal_sql", "SELECT event_id FROM events e WHERE e.ts >= 1704844800000 AND ts < '2024-01-12T02:00:00+02:00' AND ts NOT BETWEEN 1704880800 AND '2024-01-10T12:00:00Z'", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND ts NOT BETWEEN TIMESTAMP '2024-01-10 10:00:00' AND TIMESTAMP '2024-01-10 12:00:00'", "events")


@query("bool_literal_sql", "SELECT event_id FROM events WHERE event_id % 2 = 0 AND NOT (event_id % 3 = 0)")
def bool_literal_sql(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("/flags", ("event_id",), data=read(spark, sf, "events").select("event_id", (F.col("event_id") % 2 == 0).alias("even"), (F.col("event_id") % 3 == 0).alias("third"))))
    return e.sql("SELECT event_id FROM /flags WHERE even = 'yes' AND even = 1 AND even = TRUE AND third <> 'true' AND third = 'no'")


@query("pivot_sql_count", "SELECT o_orderpriority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS F_n, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS F_total, count(CASE WHEN o_orderstatus = 'x''y' THEN 1 END) AS \"x'y_n\", CAST(NULL AS DOUBLE) AS \"x'y_total\" FROM orders GROUP BY o_orderpriority")
def pivot_sql_count(spark, sf):
    out = Engine.over(spark, sf, ["orders"]).sql("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (COUNT(*) AS n, SUM(o_totalprice) AS total FOR o_orderstatus IN ('F', 'x\\'y'))")
    return out.withColumnsRenamed({"x\\'y_n": "x'y_n", "x\\'y_total": "x'y_total"}).withColumn("F_total", F.round("F_total", 2))


@query("asof_sql_alias", _ASOF.replace("a.user_id, a.ts, a.event_id, b.ts AS right_ts, b.px", "a.user_id, a.ts AS lt, b.ts AS rt, b.px, 'p.x q.y' AS note"))
def asof_sql_alias(spark, sf):
    left, right = _asof_sides(spark, sf)
    left.createOrReplaceTempView("purchases")
    right.withColumnRenamed("ts", "at").createOrReplaceTempView("quotes_at")
    return Engine(spark).sql("SELECT p.user_id, p.ts AS lt, q.at AS rt, px, 'p.x q.y' AS note FROM (SELECT * FROM purchases) AS p ASOF JOIN quotes_at q MATCH_CONDITION (p.ts >= q.at) USING (user_id)")


_ENTITLED = _state_sql("true")


@query("entitlement_sow", f"SELECT 'now' AS what, user_id, event_type, value FROM {_ENTITLED} WHERE value > 50 UNION ALL SELECT 'then', user_id, event_type, value FROM {_state_sql(f'event_id <= {_MID}')} WHERE value > 50 UNION ALL SELECT 'key', user_id, NULL, NULL FROM {_ENTITLED} WHERE value > 50 UNION ALL SELECT 'user', user_id, event_type, value FROM {_ENTITLED} WHERE value > 50 AND event_type = 'view'")
def entitlement_sow(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("/state", tuple(KEY), changelog=log_of(spark, sf), row_filter="value > 50"))
    tag = lambda d, what: d.select(F.lit(what).alias("what"), *[F.col(c) if c in d.columns else F.lit(None).cast(t).alias(c) for c, t in (("user_id", "long"), ("event_type", "string"), ("value", "double"))])
    user = e.for_user({"/state": "event_type = 'view'"})
    return tag(e.sow("state"), "now").union(tag(e.sow("state", seq=_cut(spark, sf)), "then")).union(tag(e.send_keys("state"), "key")).union(tag(user.sql("SELECT s.* FROM /state s"), "user"))


@query("publish_recover", f"SELECT user_id, event_type, value FROM {_ENTITLED} WHERE user_id % 7 <> 3 UNION ALL SELECT DISTINCT user_id, 'again', -1.0 FROM events WHERE user_id % 7 = 3 AND user_id % 2 = 0")
def publish_recover(spark, sf):
    """Publishes, deletes, a snapshot, more publishes, and the state from snapshot and log."""
    base = work_dir(spark)
    e = Engine(spark)
    e.register(TopicDef("/log", tuple(KEY), path=f"{base}/log", data=None, changelog=log_of(spark, sf).limit(0)))
    state = snapshot.latest_by_key(log_of(spark, sf), KEY).select("user_id", "event_type", "value")
    everybody = read(spark, sf, "events").select("user_id").distinct()
    e.publish("log", everybody.select("user_id", F.lit("first").alias("event_type"), F.lit(0.0).alias("value")))
    e.delete("log", everybody.join(state, "user_id", "left_anti"))
    C.write_snapshot(e.topics["log"].changelog, KEY, f"{base}/snapshot")
    e.publish("log", state)
    e.delete("log", everybody.filter("user_id % 7 = 3"))
    e.publish("log", everybody.filter("user_id % 7 = 3 AND user_id % 2 = 0").select("user_id", F.lit("again").alias("event_type"), F.lit(-1.0).alias("value")))
    C.compact(e.topics["log"].changelog, KEY, f"{base}/compact")
    recovered = C.recover(spark, f"{base}/snapshot", f"{base}/log", KEY)
    same = recovered.exceptAll(e.sow("log").select(*recovered.columns)).unionByName(C.recover(spark, f"{base}/compact", f"{base}/log", KEY).exceptAll(recovered))
    return recovered.unionByName(same.withColumn("event_type", F.lit("differs"))).select("user_id", "event_type", "value")


@query("sow_topic_ttl", f"SELECT user_id, event_type, value FROM {_ENTITLED} WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 36000 SECOND")
def sow_topic_ttl(spark, sf):
    e = Engine(spark)
    e.register(TopicDef("/state", tuple(KEY), changelog=log_of(spark, sf), expire_seconds=36000))
    now = read(spark, sf, "events").agg(F.max("ts")).first()[0]
    return e.sow("state", now=F.lit(now).cast("timestamp_ntz")).select("user_id", "event_type", "value")


@query("replay_partial_map", f"SELECT user_id, nullif(kind, 'null!') AS kind, CAST(last_s AS VARCHAR) AS last_s FROM ({_PART})")
def replay_partial_map(spark, sf):
    """Partial publishes folded into a map of whatever fields there are."""
    m = snapshot.merge_partial(_partial_log(spark, sf), KEY)
    return m.select("user_id", F.col("fields")["kind"].alias("kind"), F.col("fields")["last_s"].alias("last_s"))


dialect("group_sets", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", tables="orders")
