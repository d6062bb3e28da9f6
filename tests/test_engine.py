"""Meanings on small literal tables, limits, entitlements, codecs and the state of streams."""

import math
import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.catalog import Engine, TopicDef, ViewDef
from tidewright.operators import joins, reshape, snapshot
from tidewright.plans import guardrails
from tidewright.plans.guardrails import GuardrailError, Limits
from tidewright.sources import binary, ingest
from tidewright.sources import changelog as logs
from tidewright.streaming.runner import ContinuousQuery, GroupView, Measure, StateTable


def topic(spark, rows, schema, name="t", **more):
    e = Engine(spark)
    e.register(TopicDef(name, tuple(more.pop("keys", ())), data=spark.createDataFrame(rows, schema), **more))
    return e


def got(df):
    return [tuple(r) for r in df.collect()]


SPREAD = [(i, float(v)) for i, v in enumerate([2, 4, 4, 4, 5, 5, 7, 9])]


def test_aggregates_on_literals(spark):
    e = topic(spark, SPREAD, "id long, v double")
    assert got(e.sql("SELECT STDDEV_POP(v), STDDEV(v), VARIANCE(v) FROM t"))[0] == pytest.approx((2.0, 2.0, 4.0))
    assert got(e.sql("SELECT STDDEV_SAMP(v) FROM t"))[0][0] == pytest.approx(2.138089935299395)
    e = topic(spark, [(i, 10.0 * i) for i in range(1, 6)], "id long, v double")
    assert got(e.sql("SELECT PERCENTILE_CONT(v, 0.25) FROM t")) == [(20.0,)]
    assert got(e.sql("SELECT COUNT(*), SUM(v) FROM t WHERE v < 0")) == [(0, None)]
    assert got(e.sql("SELECT COUNT(DISTINCT v), SUM(DISTINCT v) FROM t")) == [(5, 150.0)]


def test_having_lag_like_on_literals(spark):
    desks = ["RATES"] * 3 + ["EQUITIES"] + ["FX"] * 2
    e = topic(spark, list(enumerate(desks)), "id long, desk string")
    assert got(e.sql("SELECT desk, COUNT(*) AS n FROM t GROUP BY desk HAVING COUNT(*) = 2")) == [("FX", 2)]
    e = topic(spark, [(1, "d", 100.0), (2, "d", 200.0), (3, "d", 300.0)], "id long, desk string, px double")
    assert got(e.sql("SELECT LAG(px) OVER (PARTITION BY desk ORDER BY id) AS p FROM t ORDER BY id")) == [(None,), (100.0,), (200.0,)]

    e = topic(spark, [(1, "AB1"), (2, "AB12"), (3, "AC1")], "id long, code string")
    assert got(e.sql("SELECT code FROM t WHERE code LIKE 'AB_'")) == [("AB1",)]


def test_window_without_frame_or_order_runs_by_rows(spark):
    e = topic(spark, [(i, 1) for i in range(5)], "id long, v long")
    assert sorted(got(e.sql("SELECT COUNT(*) OVER (PARTITION BY v) AS c FROM t"))) == [(i,) for i in range(1, 6)]
    assert sorted(got(e.sql("SELECT COUNT(*) OVER (PARTITION BY v ORDER BY v) AS c FROM t"))) == [(i,) for i in range(1, 6)]
    assert got(e.sql("SELECT MAX(c) FROM (SELECT COUNT(*) OVER (PARTITION BY v ORDER BY id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS c FROM t)")) == [(2,)]


def test_soft_nulls_and_folding(spark):
    e = topic(spark, [(1, 0, "abc"), (2, 4, None)], "id long, v long, s string")
    assert got(e.sql("SELECT 1 / v, CAST(s AS INT), CONCAT(s, 'x', NULL), SUBSTR('hello', -2, 3), SUBSTR('hello', 4) FROM t ORDER BY id")) == [(None, None, "abcx", "hel", "lo"), (0.25, None, "x", "hel", "lo")]
    assert got(e.sql("SELECT id FROM t WHERE UPPER(s) = 'aBc' AND LOWER(s) IN ('ABC', 'x') AND UPPER(s) NOT LIKE 'b%' AND 'Abc' = LOWER(s)")) == [(1,)]
    assert got(e.sql("SELECT 'UPPER(s) = ''a'' / 0 SUM(x)' AS kept FROM t WHERE id = 1")) == [("UPPER(s) = 'a' / 0 SUM(x)",)]
    assert got(e.sql("SELECT SUM(id * 0 + 9223372036854775807) AS s, FLOOR(2.5) + ROUND(2.5) AS f FROM t GROUP BY v / 0")) == [(None, 5.0)]
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_pivot_forms(spark):
    rows = [("alice", "RATES", 100), ("bob", "EQUITIES", 999), ("carol", "RATES", 25)]
    e = topic(spark, rows, "trader string, desk string, qty long")
    assert sorted(got(e.sql("SELECT * FROM t PIVOT (SUM(qty) FOR desk IN ('RATES', 'FX'))"))) == [("alice", 100, None), ("bob", None, None), ("carol", 25, None)]
    assert sorted(got(e.sql("SELECT * FROM t PIVOT (COUNT(qty) FOR desk IN ('RATES' AS r, 'FX'))"))) == [("alice", 1, 0), ("bob", 0, 0), ("carol", 1, 0)]
    any_ = e.sql("SELECT * FROM (SELECT trader, desk, qty FROM t WHERE qty > 50) AS x PIVOT (COUNT(*) AS n, MAX(qty) AS m FOR desk IN (ANY))")
    assert any_.columns == ["trader", "EQUITIES_n", "EQUITIES_m", "RATES_n", "RATES_m"] and sorted(got(any_)) == [("alice", 0, None, 1, 100), ("bob", 1, 999, 0, None)]
    assert got(e.sql("SELECT * FROM (SELECT * FROM t WHERE qty < 0) PIVOT (SUM(qty) FOR desk IN (ANY))")) == []
    with pytest.raises(ValueError, match="pivot"):
        Engine(spark, limits=Limits(pivot_values=1)).sql("SELECT * FROM t PIVOT (SUM(qty) FOR desk IN ('RATES', 'FX'))")
    wide = spark.createDataFrame([("alice", 100, 200), ("bob", 50, None)], "trader string, RATES long, FX long")
    assert sorted(got(reshape.unpivot(wide, ["trader"], ["RATES", "FX"], "desk", "qty"))) == [("alice", "FX", 200), ("alice", "RATES", 100), ("bob", "RATES", 50)]


def test_asof_join_in_sql(spark):
    e = topic(spark, [("k1", "A", 200, 1), ("k2", "A", 50, 2), ("k3", "B", 200, 3), ("k4", "A", 150, 4), ("k5", None, 200, 5)], "k string, symbol string, ts long, qty long", "trades")
    e.register(TopicDef("prices", data=spark.createDataFrame([("p1", "A", 100, 1.0), ("p2", "A", 150, 1.5), ("p3", "A", 250, 2.5), ("p4", "C", 1, 9.0)], "k string, symbol string, ts long, px double")))
    sql = "FROM trades p ASOF JOIN prices AS q MATCH_CONDITION (p.ts >= q.ts) USING (symbol)"
    assert sorted(got(e.sql(f"SELECT p.k, p.ts, q.ts, px, 'p.ts' AS s {sql}"))) == [("k1", 200, 150, 1.5, "p.ts"), ("k4", 150, 150, 1.5, "p.ts")]
    star = e.sql(f"SELECT * {sql} WHERE qty < 4")
    assert star.columns == ["k", "symbol", "ts", "qty", "right_k", "right_ts", "px"] and got(star) == [("k1", "A", 200, 1, "p2", 150, 1.5)]
    with pytest.raises(ValueError, match="MATCH_CONDITION"):
        e.sql("SELECT * FROM trades ASOF JOIN prices USING (symbol)")


def test_asof_ties_by_whole_numbers_beyond_doubles(spark):
    left = spark.createDataFrame([("a", 5)], "k string, ts long")
    big = 2**53
    right = spark.createDataFrame([("a", 5, big + 1, "late"), ("a", 5, big, "early")], "k string, ts long, n long, v string")
    assert got(joins.asof_join(left, right, ["k"], "ts", tiebreak="n").select("v")) == [("late",)]


def test_row_filters_hold_on_every_path(spark):
    log = spark.createDataFrame([(0, "U", datetime(2024, 1, 1), "a", 1), (1, "U", datetime(2024, 1, 2), "b", 9), (2, "U", datetime(2024, 1, 3), "a", 5)], "_seq long, _op string, _ts timestamp_ntz, id string, v long")
    e = Engine(spark)
    e.register(TopicDef("/log", ("id",), changelog=log, row_filter="v < 6"))
    at = F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz")
    for df in (e.sow("log"), e.sql("SELECT * FROM /log"), e.select("log"), e.entitled("log", "true")):
        assert got(df) == [("a", 5)]
    assert got(e.sow("log", seq=1)) == [("a", 1)] == got(e.sow("log", ts=at)) and got(e.send_keys("log")) == [("a",)]
    user = e.for_user({"log": "v > 7"})
    assert got(user.sow("log")) == got(user.sql("SELECT * FROM log")) == got(user.sql("SELECT x.id FROM log AS x JOIN log y ON x.id = y.id")) == []
    assert got(e.sql("SELECT id FROM log")) == [("a",)]  # the other engine sees what it saw


def test_views_of_a_user_are_over_his_rows(spark):
    e = topic(spark, [(1, "x", 5), (2, "y", 7)], "id long, g string, v long", keys=("id",))
    e.define_view(ViewDef("sums", "SELECT g, SUM(v) AS s FROM t GROUP BY g", ("g",), ("t",)))
    assert sorted(got(e.sql("SELECT * FROM sums"))) == [("x", 5), ("y", 7)]
    assert got(e.for_user({"t": "g = 'x'"}).sql("SELECT * FROM sums")) == [("x", 5)]
    assert e.refresh_order() == ["sums"]


def test_limits_are_enforced_by_sql(spark):
    e = topic(spark, [(i,) for i in range(10)], "id long")
    e.limits, e.budgets = Limits(max_rows=20), {"small": Limits(max_rows=3), "bytes": Limits(max_bytes=1)}
    assert e.sql("SELECT * FROM t").count() == 10 == len(got(e.sql("SELECT * FROM t", user="nobody")))
    with pytest.raises(PySparkException, match="more than 3 rows"):
        e.sql("SELECT * FROM t", user="small").collect()
    assert len(got(e.sql("SELECT * FROM t WHERE id < 3", user="small"))) == 3
    with pytest.raises(GuardrailError, match="bytes"):
        e.sql("SELECT * FROM t", user="bytes")
    assert guardrails.active_set(e.sow("t"), 10) == 10
    with pytest.raises(GuardrailError, match="too many"):
        guardrails.active_set(e.sow("t"), 9)
    assert [guardrails.interval_ms(*x) for x in ((None, 50), (0, 50), (90_000, 50), (-5, 0))] == [50, 0, 60_000, 0]
    assert Limits(max_rows=5).tighter(Limits(max_rows=0)).max_rows == 5 == Limits(max_rows=9).tighter(Limits(max_rows=5)).max_rows
    assert guardrails.estimate(spark.range(1000))["bytes"] == pytest.approx(8000, rel=0.01)


def test_view_rules(spark):
    e = topic(spark, [(1, "x", 5)], "id long, g string, v long", keys=("id",))
    for sql, why in (("SELECT * FROM t", "no aggregate"), ("SELECT id, SUM(v) FROM t GROUP BY id", "exact key")):
        with pytest.raises(GuardrailError, match=why):
            e.define_view(ViewDef("bad", sql, ("id",), ("t",)))
    for i in range(3):
        e.define_view(ViewDef(f"v{i}", f"SELECT g, COUNT(*) AS n FROM {'t' if i == 0 else f'v{i - 1}'} GROUP BY g", ("g",), ("t" if i == 0 else f"v{i - 1}",)))
    with pytest.raises(GuardrailError, match="levels"):
        e.define_view(ViewDef("v3", "SELECT g, COUNT(*) AS n FROM v2 GROUP BY g", ("g",), ("v2",)))
    with pytest.raises(GuardrailError, match="itself"):
        e.define_view(ViewDef("v0", "SELECT g, COUNT(*) AS n FROM v2 GROUP BY g", ("g",), ("v2",)))


def test_cached_answers_live_until_a_publish(spark, tmp_path):
    e = Engine(spark)
    e.register(TopicDef("t", ("id",), path=f"{tmp_path}/log", changelog=spark.createDataFrame([], "_seq long, _op string, _ts timestamp, id long, v string")))
    e.publish("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    first = e.cached("SELECT * FROM t", seconds=60)
    assert first.count() == 2 and e.cached("SELECT * FROM t", seconds=60) is first
    e.delete("t", spark.createDataFrame([(1,)], "id long"))
    assert got(e.cached("SELECT * FROM t", seconds=60)) == [(2, "b")]
    assert e.cached("SELECT * FROM t", seconds=0) is not e.cached("SELECT * FROM t", seconds=0)
    with pytest.raises(PySparkException, match="null key"):
        e.publish("t", spark.createDataFrame([(None, "c")], "id long, v string"))
    assert got(e.sow("t")) == [(2, "b")]


def test_a_log_has_the_columns_of_all_batches(spark, tmp_path):
    log, names = f"{tmp_path}/log", "_seq long, _op string, _ts timestamp, id long, v string"
    e = Engine(spark)
    e.register(TopicDef("t", ("id",), path=log, changelog=spark.createDataFrame([], names)))
    e.delete("t", spark.createDataFrame([(9,)], "id int"))  # tombstones first, keys of another type
    assert e.sow("t").dtypes == [("id", "bigint"), ("v", "string")] and got(e.sow("t")) == []
    e.publish("t", spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    logs.append(logs.delete(spark.createDataFrame([(1,)], "id long"), ["id"], 2**40).coalesce(1), f"{tmp_path}/keys")
    (part,) = (tmp_path / "keys").glob("*.parquet")
    part.rename(tmp_path / "log" / "part-0.parquet")  # the first by name has keys only
    e.register(TopicDef("t", ("id",), path=log))
    assert got(e.sow("t")) == [(2, "b")]
    logs.write_snapshot(spark.createDataFrame([], names), ["id"], f"{tmp_path}/snap")
    assert got(logs.recover(spark, f"{tmp_path}/snap", log, ["id"])) == [(2, "b")]


def test_recovery_is_the_state(spark, tmp_path):
    put = lambda rows: logs.append(spark.createDataFrame(rows, "_seq long, _op string, id string, px long").withColumn("_ts", F.lit(datetime(2024, 1, 1))), f"{tmp_path}/log")
    put([(0, "U", "A", 10), (1, "U", "A", 20), (2, "U", "B", 99), (3, "U", "C", 1)])
    logs.write_snapshot(spark.read.parquet(f"{tmp_path}/log"), ["id"], f"{tmp_path}/snap")
    put([(4, "D", "B", None), (5, "U", "A", 30)])
    assert sorted(got(logs.recover(spark, f"{tmp_path}/snap", f"{tmp_path}/log", ["id"]))) == [("A", 30), ("C", 1)]
    log = spark.read.parquet(f"{tmp_path}/log")
    assert [sorted(r[1] for r in got(snapshot.as_of_seq(log, ["id"], s))) for s in (0, 1, 2)] == [[10], [20], [20, 99]]
    assert sorted(got(logs.replicate(log, "px", "99", ["_ts"]).select("_seq"))) == [(2,), (4,)]


def test_binary_codecs(spark):
    row = {"n": None, "t": True, "i": -2**40, "s": "é" * 40, "d": 1.5, "b": b"\0x", "l": [1, 2**63, -1, -129, 200, 70000], "m": {"k": [None, False]}, "at": datetime(2024, 1, 2, 3, 4, 5, 6000)}
    back = binary.unpack(binary._Reader(binary.pack(row)))
    assert back == row | {"at": "2024-01-02T03:04:05.006000"}
    small = {k: v for k, v in row.items() if k != "l"} | {"l": [1, 2**40]}
    assert binary.unbson(binary._Reader(binary.bson(small))) == small
    schema = T.StructType([T.StructField("i", T.LongType()), T.StructField("d", T.DoubleType()), T.StructField("x", T.StringType())])
    bad = [binary.pack({"i": 1, "d": 2.5, "y": 3}), binary.pack({"i": "text", "d": 1}), b"\x81", binary.pack([1]), b"", None, binary.pack("a" * 70)[:20]]
    df = spark.createDataFrame([(b,) for b in bad], "payload binary")
    assert got(binary.decode_rows(df, "msgpack", schema)) == [(1, 2.5, None), (None, 1.0, None)] + [(None, None, None)] * 5
    deep = b"\x91" * 40 + b"\xc0"
    with pytest.raises(ValueError, match="deep"):
        binary.unpack(binary._Reader(deep))
    df = spark.createDataFrame([(binary.bson({"i": 7})[:-1],), (binary.bson({"i": 7, "x": "z"}),)], "payload binary")
    assert got(binary.decode_rows(df, "bson", schema)) == [(None, None, None), (7, None, "z")]


def test_ingest_rules(spark):
    df = spark.createDataFrame([("Yes", "2024-01-02T03:04:05Z"), ("0", "1704164645"), ("off", "1704164645000000000"), (None, "2024-01-02")], "f string, t string")
    rows = got(df.select(ingest.to_bool(F.col("f")), ingest.to_timestamp(F.col("t"))))
    assert [r[0] for r in rows] == [True, False, None, None] and rows[0][1] == rows[1][1] == rows[2][1]
    assert ingest.schema_change(["a", "b"], ["b", "c"]) == {"added": ["c"], "removed": ["a"]}
    assert [ingest.widen(*x) for x in (("int", "bigint"), ("bigint", "double"), ("int", "string"))] == ["bigint", "double", "string"]
    assert got(ingest.add_column(spark.range(1), "x", "string")) == [(0, None)]
    assert math.isnan(float("nan")) and got(ingest.clean_nan(spark.createDataFrame([(float("nan"),)], "x double"))) == [(None,)]


LOG = T.StructType([T.StructField("_seq", T.LongType()), T.StructField("_op", T.StringType()), T.StructField("_ts", T.TimestampNTZType()), T.StructField("id", T.LongType()), T.StructField("g", T.StringType()), T.StructField("v", T.LongType())])


def batch(spark, *rows):
    return spark.createDataFrame([(s, op, datetime(2024, 1, 1, 0, s), i, g, v) for s, op, i, g, v in rows], LOG)


def test_state_is_bounded_and_replays(spark, tmp_path):
    t = StateTable(spark, f"{tmp_path}/s", ["id"], LOG, buckets=2)
    view = GroupView(spark, f"{tmp_path}/v", ["g"], [Measure("n", "count", F.lit(1)), Measure("s", "sum", F.col("v")), Measure("m", "avg", F.col("v"))], having="n > 1 OR s > 5", buckets=2)
    q = ContinuousQuery(t, f"{tmp_path}/o", kind="aggregate", view=view)
    deltas = lambda b: sorted(got(spark.read.parquet(f"{tmp_path}/o/batch={b}").select("_delta", "g", "n", "s")), key=str)
    q.on_batch(batch(spark, (0, "U", 1, "x", 3), (1, "U", 2, "x", 4), (2, "U", 3, None, 9)), 0)
    assert deltas(0) == [("add", "x", 2, 7), ("add", None, 1, 9)]
    second = batch(spark, (4, "U", 2, "y", 4), (5, "D", 3, None, None), (3, "U", 2, "x", 100))  # the last is late
    for _ in range(2):  # a replay of the batch changes nothing
        q.on_batch(second, 1)
        assert deltas(1) == [("remove", "x", 2, 7), ("remove", None, 1, 9)]
    for b in range(2, 7):
        q.on_batch(batch(spark, (b + 10, "U", 1, "x", b), (b + 20, "U", 2, "x", 1)), b)
    assert sorted(got(view.read(6))) == [("x", 2, 7, 3.5)]
    versions = sorted(d for d in os.listdir(f"{tmp_path}/s") if d.startswith("version") and os.listdir(f"{tmp_path}/s/{d}") and any(x.startswith("bucket") for x in os.listdir(f"{tmp_path}/s/{d}")))
    assert len(versions) <= 4 and len([d for d in os.listdir(f"{tmp_path}/s") if d.startswith("manifest")]) <= 4
    q.on_batch(batch(spark, (40, "U", 4, "z", 50)), 7)
    assert deltas(7) == [("add", "z", 1, 50)]


def test_a_restart_reads_the_last_manifest(spark, tmp_path):
    make = lambda: ContinuousQuery(StateTable(spark, f"{tmp_path}/s", ["id"], LOG, buckets=2), f"{tmp_path}/o", where="v > 5", most=2)
    make().on_batch(batch(spark, (0, "U", 1, "x", 9), (1, "U", 2, "x", 1)), 0)
    q = make()
    q.on_batch(batch(spark, (2, "U", 1, "x", 1), (3, "U", 2, "x", 8), (4, "U", 3, "x", 7)), 1)
    assert sorted(got(spark.read.parquet(f"{tmp_path}/o/batch=1").select("_delta", "id", "v"))) == [("add", 2, 8), ("add", 3, 7), ("oof", 1, 9)]
    assert q.active == 2
    with pytest.raises(GuardrailError, match="too many matches"):
        q.on_batch(batch(spark, (5, "U", 9, "x", 9)), 2)


def test_expired_rows_leave_without_being_written(spark, tmp_path):
    t = StateTable(spark, f"{tmp_path}/s", ["id"], LOG, buckets=4, expire_seconds=600)
    q = ContinuousQuery(t, f"{tmp_path}/o", where="v > 0")
    q.on_batch(batch(spark, (0, "U", 1, "x", 9), (5, "U", 2, "x", 9)), 0)
    q.on_batch(batch(spark, (12, "U", 3, "x", 9)), 1)  # twelve minutes: row 1 is over ten old, row 2 is not
    assert sorted(got(spark.read.parquet(f"{tmp_path}/o/batch=1").select("_delta", "id"))) == [("add", 3), ("remove", 1)]
    assert sorted(r["id"] for r in t.read(1).collect()) == [2, 3]


def test_top_n_of_a_stream(spark, tmp_path):
    t = StateTable(spark, f"{tmp_path}/s", ["id"], LOG, buckets=3)
    q = ContinuousQuery(t, f"{tmp_path}/o", kind="topn", order=[F.col("v").desc(), F.col("id")], n=2)
    q.on_batch(batch(spark, *[(i, "U", i, "x", i) for i in range(6)]), 0)
    assert sorted(got(spark.read.parquet(f"{tmp_path}/o/batch=0").select("_delta", "id"))) == [("add", 4), ("add", 5)]
    q.on_batch(batch(spark, (9, "U", 0, "x", 50), (10, "D", 5, "x", None)), 1)
    assert sorted(got(spark.read.parquet(f"{tmp_path}/o/batch=1").select("_delta", "id"))) == [("add", 0), ("remove", 5)]
    q.on_batch(batch(spark, *[(20 + i, "D", i, "x", None) for i in range(6)]), 2)
    assert sorted(got(spark.read.parquet(f"{tmp_path}/o/batch=2").select("_delta", "id"))) == [("remove", 0), ("remove", 4)]
