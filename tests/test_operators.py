"""Hand-computed edge cases of the analytics operators."""

import datetime as dt
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators import aggregates, bonds, commodity, filling, filters, intraday, joins, loans, quality, scoring, stress, tables
from riskspark.operators.partitioned import Partitioned, bucket, daily, monthly
from riskspark.sources import scans
from riskspark.streaming import engine

DAY = dt.date(2024, 1, 1)


def days(n):
    return [DAY + dt.timedelta(days=i) for i in range(n)]


def test_rolling_least_values_and_nulls(spark):
    df = spark.createDataFrame([("a", d, x) for d, x in zip(days(5), [1.0, None, 3.0, 5.0, 5.0])], "k string, date date, x double")
    w = W.over(["k"], "date")
    rows = df.select("date", W.mean(F.col("x"), w, 3, 2).alias("m"), W.deviation(F.col("x"), w, 2).alias("s"), W.quantile(F.col("x"), w, 2, 0.5).alias("q")).orderBy("date").collect()
    assert [r["m"] for r in rows] == [None, None, 2.0, 4.0, pytest.approx(13 / 3)]
    assert [r["s"] for r in rows] == [None, None, None, pytest.approx(2**0.5), 0.0]
    assert rows[4]["q"] == 5.0


def test_ewm_matches_pandas(spark):
    x = [1.0, 4.0, 2.0, 8.0, 5.0]
    df = spark.createDataFrame([("a", d, v) for d, v in zip(days(5), x)], "k string, date date, x double")
    got = [r[0] for r in df.orderBy("date").select(W.smoothed(F.col("x"), W.over(["k"], "date"), 10)).collect()]
    assert got == pytest.approx(pd.Series(x).ewm(span=10, adjust=False).mean().tolist())


def test_constant_group_scales_to_zero_and_ranks_tie(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, None)], "k int, x double")
    assert {r[0] for r in df.where("k = 1").select(W.scaled(F.col("x"), W.over(["k"]))).collect()} == {0.0}
    ranks = [(r["x"], r["r"]) for r in aggregates.fractional_rank(df, "x", "r").collect()]
    assert sorted(ranks, key=str) == sorted([(2.0, 0.625), (2.0, 0.625), (1.0, 0.25), (3.0, 1.0), (None, None)], key=str)


def test_stable_hash_matches_python(spark):
    import hashlib

    keys = ["a", "", "EqFwd_S1_2001-01-01_M", "é"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    for m in (5, 10, 10_000):
        got = {r["k"]: r["h"] for r in df.select("k", S.stable_hash(F.col("k"), m).alias("h")).collect()}
        assert got == {k: int(hashlib.sha256(k.encode()).hexdigest(), 16) % m for k in keys}


def test_a_filter_on_trades_works_each_hash_out_once(spark):
    import hashlib

    from riskspark.operators import trades

    df = spark.createDataFrame([(dt.date(2001, 1, 2), f"S{k}", "x", "y", 1.5, None if k % 9 == 0 else 10.0 * k) for k in range(60)], "date date, ticker string, sector string, industry string, p double, q double")
    made = tables.staged(trades.all_trades(*[trades.trade_schema(df, k, "p", "q") for k in trades.KIND]))
    called = trades.collateral_detail(made).where("margin_call_flag = 1")
    plan = called._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") <= 6, plan.count("sha2(")  # four of the columns, and the filter's own
    number = lambda text: int(hashlib.sha256(text.encode()).hexdigest(), 16)
    rows, ladder = called.collect(), lambda x, steps: next((n for n, e in steps if x < e), steps[-1][0])
    assert len(rows) == 4 * 53  # no notional, or one of zero: no call
    for r in rows:
        assert r["counterparty"] == trades.COUNTERPARTIES[number(r["trade_id"]) % 5] and r["reuse_flag"] == (number(r["trade_id"] + "reuse") % 10_000 < 3500)
        assert r["collateral_type"] == ladder(number(r["trade_id"] + r["asset_class"]) % 10_000 / 10_000, trades.MENU[r["asset_class"]])
    assert trades.derivative_trades(made)._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    null = spark.createDataFrame([(None,), (0.5,)], "x double").select(S.ladder(F.col("x"), (("a", 0.7), ("b", 1.0))).alias("y")).collect()
    assert [r["y"] for r in null] == ["b", "a"]


def test_timestamps_and_bins(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("1704164645000000000",), ("02-01-2024",), ("x",)], "t string")
    got = [r[0] for r in df.select(F.date_format(S.any_timestamp(F.col("t")), "yyyy-MM-dd")).collect()]
    assert got == ["2024-01-02"] * 3 + [None]
    row = spark.range(1).select(S.bins(F.lit(2.0), (2, 6), ("a", "b", "c")), S.bins(F.lit(2.1), (2, 6), ("a", "b", "c")), S.tidy(F.lit(" x ")), S.tidy(F.lit("  "))).first()
    assert list(row) == ["a", "b", "X", None]


def test_sessions_and_calendar(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(filters.equity_session(at("2024-01-02 14:30:00")), filters.equity_session(at("2024-01-02 21:00:00")), filters.fx_session(at("2024-01-05 21:59:00")), filters.fx_session(at("2024-01-05 22:00:00"))).first()
    assert list(row) == [True, False, True, False]
    assert filters.trading_days(spark, "2024-01-01", "2024-01-07", ["2024-01-01"]).count() == 4
    assert filters.effective_end(dt.datetime(2024, 1, 2, 15)) == DAY and filters.effective_end(dt.datetime(2024, 1, 2, 16)) == dt.date(2024, 1, 2)


def test_synthetic_days_use_earlier_synthetic_ones(spark):
    bars = spark.createDataFrame([("G", d, x, x, x, x, x) for d, x in zip(days(2), [1.0, 2.0])], "commodity string, date date, open double, high double, low double, close double, volume double")
    calendar = spark.createDataFrame([(d,) for d in days(4)], "date date")
    got = [(r["close"], r["data_quality_flag"]) for r in commodity.synthetic_days(bars, calendar).orderBy("date").collect()]
    assert got == [(1.0, "REAL"), (2.0, "REAL"), (1.5, "SYNTHETIC"), (1.5, "SYNTHETIC")]


def test_as_of_and_active_months(spark):
    left = spark.createDataFrame([("p", d) for d in days(3)], "k string, date date")
    right = spark.createDataFrame([("p", days(2)[1], 7.0)], "k string, date date, v double")
    assert [r["v"] for r in joins.as_of(left, right, "k", "date", "v").orderBy("date").collect()] == [None, 7.0, 7.0]
    loans = spark.createDataFrame([(1, dt.date(2024, 1, 15), dt.date(2024, 3, 1)), (2, dt.date(2024, 1, 15), dt.date(2024, 1, 20))], "id int, a date, b date")
    assert [(r["id"], r["month"].month) for r in joins.active_months(loans, "a", "b").orderBy("id", "month").collect()] == [(1, 2), (1, 3)]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([("a", days(1)[0], 1), ("b", days(1)[0], 2)], "k string, date date, v int")
    new = spark.createDataFrame([("a", days(1)[0], 9)], "k string, date date, v int")
    assert sorted(r["v"] for r in tables.merged(old, new, ["k", "date"]).collect()) == [2, 9]
    with pytest.raises(quality.QualityError):
        tables.merged(old, new.union(new), ["k"])
    t = Partitioned(spark, str(tmp_path / "t"), daily())
    assert t.read() is None
    t.append(old)
    t.merge(new, ["k", "date"])
    assert sorted(r["v"] for r in t.read().collect()) == [2, 9]
    ticks = spark.createDataFrame([("a", dt.datetime(2024, 1, 2, 3), 1.0)], "k string, ts timestamp, v double")
    tables.append_hourly(ticks, str(tmp_path / "h"), "live")
    assert spark.read.parquet(str(tmp_path / "h/live")).first()["hour"] == 22
    tables.write_run(old, str(tmp_path / "r"), "r1")
    tables.write_run(new, str(tmp_path / "r"), "r2")
    assert [r["v"] for r in scans.newest_runs(spark.read.parquet(str(tmp_path / "r"))).collect()] == [9]
    catalog = tables.for_catalog(old, {"name": "string", "v": "long"}, {"k": "name"})
    assert catalog.dtypes == [("name", "string"), ("v", "bigint")]
    with pytest.raises(quality.QualityError):
        tables.for_catalog(old, {"absent": "string"}, {})


def test_scans(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,d\n1,31-12-2023\n")
    assert scans.day_first_csv(spark, str(tmp_path / "d.csv"), "a int, d date").first()["d"] == dt.date(2023, 12, 31)
    df = spark.createDataFrame([(1, "x")], "v int, p string")
    df.write.partitionBy("p").parquet(str(tmp_path / "f"))
    df.withColumn("v", F.lit(2)).write.partitionBy("p").mode("append").parquet(str(tmp_path / "f"))
    assert scans.newest_files(spark, str(tmp_path / "f"), ["p"]).count() == 1
    assert "topic" in scans.replay(spark, [str(tmp_path / "f")]).columns


def test_quality(spark):
    df = spark.createDataFrame([("1", "x"), ("y", "2")], "a string, b string")
    with pytest.raises(quality.QualityError, match="a .1 to int., b .1 to int."):
        quality.enforce_schema(df, {"a": "int", "b": "int"})
    with pytest.raises(quality.QualityError, match="missing columns: c"):
        quality.enforce_schema(df, {"c": "int"})
    assert quality.enforce_schema(df.limit(1), {"a": "int"}).dtypes == [("a", "int"), ("b", "string")]
    with pytest.raises(quality.QualityError):
        quality.failure_gate(2, 10)
    with pytest.raises(quality.QualityError):
        quality.validated(df, ["a"], F.col("a") == "y")
    assert quality.validated(df, ["a"], F.lit(False)).count() == 2
    assert len(quality.schema_hash({"a": "int"})) == 32
    level = spark.createDataFrame([(k, float(i % 3), float(i)) for i, k in enumerate("abcdefgh")], "k string, v double, l double")
    assert {r["type"] for r in quality.spread_drift(level.limit(2).withColumn("l", F.lit(100.0)), level, "k", "v", "l").collect()} == {"level_shift", "coverage_drop"}


def test_scoring_and_stress(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    soft = scoring.scored(df, "y", ["x", "z"], lambda f: f["x"] + f["z"] + 1)
    assert [r["y"] for r in soft.collect()] == [2.0, 1.0] and [r["x"] for r in soft.collect()] == [1.0, None]
    with pytest.raises(Exception, match="null"):
        scoring.scored(df, "y", ["x"], scoring.linear({"x": 1.0}), strict=True).collect()
    with pytest.raises(ValueError, match="missing"):
        scoring.scored(df, "y", ["q"], scoring.linear({"x": 1.0}), strict=True)
    cases = stress.scenarios(spark, [("mine", -9.0, 9.0, 0.1)]).where("scenario = 'mine'").first()
    assert (cases["ret_shift"], cases["vol_multiplier"], cases["var_multiplier"]) == (-0.3, 3.0, 0.5)


def test_yield_fallback(spark):
    calendar = spark.createDataFrame([(d,) for d in days(2)], "date date")
    none = spark.createDataFrame([], "date date, dgs10 double")
    assert [(r["dgs10"], r["fill_method_flag"]) for r in bonds.yield_series(none, none, calendar).collect()] == [(0.0, "BACKWARD_FILLED")] * 2


def bars(n, late=()):
    base = dt.datetime(2024, 1, 2, 15, 0)
    return [("t", base + dt.timedelta(minutes=i), base + dt.timedelta(minutes=i + (60 if i in late else 0)), 10.0 + i % 5, 11.0 + i % 5, 9.0, 10.0 + (i * 7) % 5, float(i % 4)) for i in range(n)]


SCHEMA = "ticker string, ts timestamp, arrival timestamp, open double, high double, low double, close double, volume double"


def test_stream_matches_batch(spark, tmp_path):
    df = spark.createDataFrame(bars(40), SCHEMA)
    for k, part in enumerate(("minute(ts) < 20", "minute(ts) >= 20")):
        df.where(part).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = engine.metrics_stream(source).writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    names = ["ts", *intraday.EQUITY_METRICS]
    got = [tuple(r) for r in spark.table("streamed").select(*names).orderBy("ts").collect()]
    want = [tuple(r) for r in intraday.metrics(df).select(*names).orderBy("ts").collect()]
    assert len(got) == len(want) == 40
    for a, b in zip(got, want):
        assert a[0] == b[0] and list(a[1:]) == pytest.approx(list(b[1:]), nan_ok=True)


def test_late_rows_stay_in_the_buffer(spark, tmp_path):
    spark.createDataFrame(bars(10, late=(4,)), SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    q = engine.metrics_stream(source).writeStream.format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = {r["ts"].minute: r["close_diff"] for r in spark.table("late").collect()}
    assert 4 not in rows and len(rows) == 9
    closes = [b[6] for b in bars(10)]
    assert rows[5] == closes[5] - closes[4]


def test_envelopes_and_sinks(spark, tmp_path):
    import json

    body = {"batch_id": "b", "tickers": [{"ticker": "a", "open": 1, "high": 2, "low": 1, "close": 2, "volume": 3, "timestamp": "2024-01-02T15:00:00Z"}, {"ticker": "b", "open": 1, "high": 1, "low": 2, "close": 1, "volume": 0, "timestamp": "2024-01-02T15:00:00Z"}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.json").write_text(json.dumps(body))
    stream = scans.decoded(scans.files(spark, str(tmp_path / "in")))
    ready = engine.counted(engine.deduplicated(stream.withColumn("arrival", F.col("ts"))))
    engine.run(ready, str(tmp_path / "out"), str(tmp_path / "ck"), "backfill", run_id="r").awaitTermination(120)
    assert [r["ticker"] for r in spark.read.parquet(str(tmp_path / "out/bars/backfill")).collect()] == ["a"]
    dead = spark.read.parquet(str(tmp_path / "out/dead/backfill")).first()
    assert dead["key"] == "b" and dead["error"] == "high is below low" and json.loads(dead["original"])["ticker"] == "b"


def test_restart_takes_the_session_before_it(spark, tmp_path):
    base = dt.datetime(2024, 1, 2, 15, 0)  # 10:00 in New York
    rows = spark.createDataFrame(bars(40), SCHEMA)
    start = base + dt.timedelta(minutes=30)
    assert engine.recovery_rows(rows, start).count() == 15
    assert engine.recovery_rows(rows.withColumn("ts", F.expr("ts - interval 40 minutes")), base - dt.timedelta(minutes=16)).count() == 0  # 9:44, the session has just begun
    assert engine.recovery_rows(rows, start + dt.timedelta(days=1)).count() == 0
    rows.where(F.col("ts") < F.lit(start)).coalesce(1).write.parquet(str(tmp_path / "raw"))
    rows.where(F.col("ts") >= F.lit(start)).coalesce(1).write.parquet(str(tmp_path / "live"))
    read = lambda name: spark.readStream.schema(SCHEMA).parquet(str(tmp_path / name))
    engine.metrics_stream(read("live"), history=engine.recovery_rows(read("raw"), start)).writeStream.format("memory").queryName("restarted").trigger(availableNow=True).start().awaitTermination(120)
    got = {r["ts"]: r["vol_15m"] for r in spark.table("restarted").collect()}
    want = {r["ts"]: r["vol_15m"] for r in intraday.metrics(rows).collect() if r["ts"] >= start}
    assert got.keys() == want.keys() and len(got) == 10 and all(got[k] == pytest.approx(want[k]) for k in got)


def test_a_batch_twice_and_the_latest_rows(spark, tmp_path):
    rows = spark.createDataFrame(bars(6), SCHEMA)
    for part in (rows.where("minute(ts) < 4"), rows, rows):
        engine.keep_latest(part, str(tmp_path / "latest"))
    now = dt.datetime(2024, 1, 2, 15, 20)
    (row,) = engine.snapshot(spark, str(tmp_path / "latest"), now).collect()
    assert row["ts"] == dt.datetime(2024, 1, 2, 15, 5) and row["is_stale"]
    assert not engine.snapshot(spark, str(tmp_path / "latest")).first()["is_stale"]


def _drained(df, name):
    df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination(180)
    return df.sparkSession.table(name)


def _files(spark, rows, path, cut):
    """A stream of files, one a micro-batch, cut by an expression in arrival order."""
    for k in sorted(r[0] for r in rows.select(F.expr(cut)).distinct().collect()):
        rows.where(F.expr(cut) == k).coalesce(1).write.parquet(f"{path}/{k:03d}")
        time.sleep(0.05)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)


def _disordered(spark, keys=3, n=50):
    """Bars of some keys, some of which arrive up to nine minutes after others that are newer."""
    r = random.Random(9)
    rows = [(f"k{k}", *b[1:2], b[1] + dt.timedelta(seconds=r.choice([1, 1, 2, 130, 540])), *b[3:]) for k in range(keys) for b in bars(n)]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.mark.parametrize("cut", ["0", "minute(arrival) div 9", "minute(arrival) div 20"])
def test_batches_make_no_difference_in_order_of_arrival(spark, tmp_path, cut):
    df = _disordered(spark).withColumn("late", F.expr("arrival > ts + interval 5 minutes"))
    got = _drained(engine.metrics_stream(_files(spark, df.drop("late"), str(tmp_path / "in"), cut), rows=12, order=("arrival", "ts")), f"cut{abs(hash(cut))}")
    accepted = intraday.in_order(df, "ticker", ["arrival", "ts"])
    assert accepted.count() < df.count()
    want = intraday.metrics(accepted, rows=12).where("not late")
    names = ["ticker", "ts", *intraday.EQUITY_METRICS]
    rows = lambda x: sorted(map(tuple, x.select(*names).collect()))
    assert [x[:2] for x in rows(got)] == [x[:2] for x in rows(want)] and len(rows(got)) > 50
    for a, b in zip(rows(got), rows(want), strict=True):
        assert list(a[2:]) == pytest.approx(list(b[2:]), nan_ok=True)


def test_batches_in_order_of_time_are_the_batch_rule(spark, tmp_path):
    df = _disordered(spark).withColumn("batch", F.expr("minute(arrival) div 7"))
    got = _drained(engine.metrics_stream(_files(spark, df.drop("batch"), str(tmp_path / "in"), "minute(arrival) div 7"), late=60), "by_time")
    want = intraday.in_order(df, "ticker", ["batch", "ts"])
    key = lambda x: sorted(map(tuple, x.select("ticker", "ts").collect()))
    assert key(got) == key(want)


def test_evicted_keys_start_anew(spark, tmp_path):
    base, r = dt.datetime(2024, 1, 2, 15, 0), random.Random(2)
    rows = [(r.choice("abcd"), base + dt.timedelta(minutes=i), base + dt.timedelta(minutes=i), 1.0, 9.0, 1.0, float(r.randrange(5, 90)), 1.0) for i in range(60)]
    known, held, want = [], {}, {}
    for ticker, ts, _, _, _, _, close, _ in rows:
        if ticker not in known:
            if len(known) == 2:
                held.pop(known.pop(0))
            known.append(ticker)
            held[ticker] = []
        want[ts] = close - held[ticker][-1] if held[ticker] else None
        held[ticker].append(close)
    assert 10 < sum(x is None for x in want.values()) < 50
    for k, cut in enumerate(("minute(ts) div 13", "0")):
        stream = _files(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / f"in{k}"), cut)
        got = _drained(engine.metrics_stream(stream, cap=2, shards=1), f"capped{k}")
        assert {x["ts"]: x["close_diff"] for x in got.collect()} == want


def test_a_late_bar_before_a_new_admission(spark, tmp_path):
    base = dt.datetime(2024, 1, 2, 15, 0)
    bar = lambda ticker, minute, late, close: (ticker, base + dt.timedelta(minutes=minute), base + dt.timedelta(minutes=late), 1.0, 9.0, 1.0, close, 1.0)
    rows = [bar("a", 5, 5, 10.0), bar("a", 4, 20, 20.0), bar("b", 21, 21, 30.0), bar("a", 22, 22, 40.0), bar("a", 23, 23, 45.0)]
    stream = _files(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path / "in"), "minute(arrival) div 10")
    got = _drained(engine.metrics_stream(stream, cap=1, order=("arrival", "ts")), "late_then_anew")
    assert {(x["ticker"], x["ts"].minute): x["close_diff"] for x in got.collect()} == {("a", 5): None, ("b", 21): None, ("a", 22): None, ("a", 23): 5.0}


def test_replay_keeps_events_of_one_time(spark, tmp_path):
    import duckdb
    from riskspark.plans import registry

    at = dt.datetime(2024, 1, 2, 15)
    rows = [(k, at + dt.timedelta(minutes=k // 2), 1, "view", 10.0 + k, '{"k": 1}') for k in range(1, 40)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = registry.queries()["ST10_replay"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT event_id, error FROM ({registry.oracle_sql()['ST10_replay']})").fetchall()
    assert sorted((r["event_id"], r["error"] or "") for r in got) == sorted((k, e or "") for k, e in want) and len(got) == 39


def test_equity_windows_share_the_shuffle_of_their_bars(spark):
    from riskspark.plans import fixtures, market

    sf, rows = "/root/testdata/sf0.001", lambda df: sorted(map(str, df.collect()))
    plan = market.equity_features(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1, plan
    bars = fixtures.bars_daily(spark, sf)
    assert rows(fixtures.bars_by_ticker(spark, sf).select(bars.columns)) == rows(bars)


def test_no_volatility_while_a_fall_to_zero_is_in_the_window(spark):
    closes = [10.0, 11.0, 0.0, 12.0, 13.0, 14.0, 15.0, 16.0]
    rows = [("a", dt.datetime(2024, 1, 2, 15, 3 * k), dt.datetime(2024, 1, 2, 15, 3 * k), c, c, c, c, 1.0) for k, c in enumerate(closes)]
    got = [r["vol_15m"] for r in intraday.metrics(spark.createDataFrame(rows, SCHEMA), rows=4).orderBy("ts").collect()]
    assert [x is None for x in got] == [True, False, True, True, True, False, False, False]


@pytest.mark.parametrize("name", ["ST05_stream_late", "ST06_stream_all_metrics", "ST08_restarted", "ST09_one_key"])
def test_micro_batches_of_ranges_of_time_make_no_difference(spark, monkeypatch, name):
    from riskspark.plans import q_sinks, registry

    rows = lambda: sorted(map(str, registry.queries()[name](spark, "/root/testdata/sf0.001").collect()))
    whole = rows()
    monkeypatch.setattr(q_sinks, "BATCH", 300)
    assert rows() == whole and len(whole) > 300


def test_a_batch_is_the_state_to_begin_with(spark, tmp_path):
    rows = spark.createDataFrame([(k, *b[1:]) for k in ("a", "b", "idle") for b in bars(40)], SCHEMA)
    start = dt.datetime(2024, 1, 2, 15, 30)
    before, after = rows.where(F.col("ts") < F.lit(start)), rows.where(F.col("ts") >= F.lit(start)).where("ticker <> 'idle'")
    for k, cap in enumerate((None, 5)):
        stream = _files(spark, after, str(tmp_path / f"in{k}"), "minute(ts) div 5")
        got = _drained(engine.metrics_stream(stream, rows=14, initial=engine.recovery_rows(before, start), cap=cap), f"begun{k}")
        want = intraday.metrics(rows, rows=14).where("ticker <> 'idle'").where(F.col("ts") >= F.lit(start))
        names = ["ticker", "ts", *intraday.EQUITY_METRICS]
        got, want = (sorted(map(tuple, x.select(*names).collect())) for x in (got, want))
        assert len(got) == 20
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and list(a[2:]) == pytest.approx(list(b[2:]), nan_ok=True)


def test_idle_keys_lose_their_state(spark, tmp_path):
    rows = spark.createDataFrame(bars(6), SCHEMA)
    rows.where("minute(ts) < 3").coalesce(1).write.parquet(str(tmp_path / "in/0"))
    source = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = engine.metrics_stream(source, idle="2 seconds").writeStream.format("memory").queryName("idle").trigger(processingTime="1 second").start()
    try:
        out = spark.table("idle")
        for _ in range(60):
            if out.count() == 3:
                break
            time.sleep(1)
        time.sleep(8)  # the timer fires in a batch without rows
        rows.where("minute(ts) >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in/1"))
        for _ in range(60):
            if out.count() == 6:
                break
            time.sleep(1)
    finally:
        q.stop()
    got = {r["ts"].minute: r["close_diff"] for r in out.collect()}
    assert got[0] is None and got[1] is not None and got[3] is None and got[4] is not None


def test_layers_point_to_the_latest_run(spark, tmp_path):
    day = lambda d, x: spark.createDataFrame([(dt.date(2024, 1, d), x)], "date date, x int")
    layer = tables.Runs(spark, str(tmp_path / "layer"))
    layer.write(day(1, 1).unionByName(day(2, 2)), "a")
    layer.write(day(2, 3), "b")
    layer.write(day(2, 3), "b")
    assert sorted((r["date"].day, r["x"]) for r in layer.read().collect()) == [(1, 1), (2, 3)]


def _written(path):
    return {str(p.relative_to(path)): p.stat().st_size for p in path.rglob("*.parquet")}


def test_a_merge_into_one_date_writes_one_date(spark, tmp_path):
    df = spark.range(20_000).select((F.col("id") % 20).alias("k"), F.expr("date_add(date'2020-01-01', cast(id div 20 as int))").alias("date"), F.rand(3).alias("v"))
    table = Partitioned(spark, str(tmp_path), daily())
    table.append(df)
    before = _written(tmp_path / "data")
    assert len(table.manifest()[0]) == 1000
    new = df.where("date = '2021-05-05' and k < 7").withColumn("v", F.lit(-1.0)).unionByName(spark.createDataFrame([(99, dt.date(2021, 5, 5), -1.0)], df.schema))
    fresh = table.merge(new, ["k", "date"])
    after = _written(tmp_path / "data")
    assert list(fresh) == ["2021-05-05"] and {k: after[k] for k in before} == before
    assert sum(after[k] for k in after.keys() - before.keys()) < 0.02 * sum(before.values())
    got = table.read()
    assert got.count() == 20_001 and got.where("v = -1").count() == 8 and got.schema["date"].dataType.simpleString() == "date"
    assert table.read(["2021-05-05"]).count() == 21


def test_changes_of_parts(spark, tmp_path):
    day = lambda *d: spark.createDataFrame([(k, dt.date(2024, *x) if x else None, v) for k, x, v in d], "k string, date date, v int")
    rows = lambda t: sorted((r["k"], str(r["date"]), r["v"]) for r in t.read().collect())
    t = Partitioned(spark, str(tmp_path / "t"), monthly())
    t.append(day(("a", (1, 5), 1), ("a", (1, 20), 2), ("a", (2, 3), 3), ("b", (3, 1), 4), ("n", None, 5)))
    assert set(t.replace_dates(day(("c", (1, 6), 6)), "2024-01-04", "2024-01-10")) == {"2024-01"}
    assert rows(t) == [("a", "2024-01-20", 2), ("a", "2024-02-03", 3), ("b", "2024-03-01", 4), ("c", "2024-01-06", 6), ("n", "None", 5)]
    assert set(t.replace_months(day(("d", (2, 9), 7)))) == {"2024-02"}
    t.merge(day(("b", (2, 1), 8)), ["k"], moves=True)
    assert rows(t) == [("a", "2024-01-20", 2), ("b", "2024-02-01", 8), ("c", "2024-01-06", 6), ("d", "2024-02-09", 7), ("n", "None", 5)]
    t.replace_dates(day(), "2024-02-05", "2024-02-28")
    t.keep_dates(2)
    assert rows(t) == [("a", "2024-01-20", 2), ("b", "2024-02-01", 8), ("n", "None", 5)]
    t.serve(day(("z", (2, 1), 1), ("y", (4, 1), 1)), 2)
    assert rows(t) == [("n", "None", 5), ("y", "2024-04-01", 1), ("z", "2024-02-01", 1)]
    with pytest.raises(quality.QualityError):
        t.merge(day(("q", (1, 1), 1), ("q", (1, 1), 2)), ["k", "date"])
    with pytest.raises(quality.QualityError):
        t.change(["2024-02"], lambda old: old.unionByName(day(("y", (4, 2), 1))))
    t.append(day(("w", (5, 1), 1)).withColumn("more", F.lit("x")))
    assert {r["k"]: r["more"] for r in t.read().collect()} == {"n": None, "y": None, "z": None, "w": "x"}


def test_a_stale_change_is_refused_and_a_vacuum_keeps_what_is_named(spark, tmp_path):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 1), 1), ("b", dt.date(2024, 2, 1), 2)], "k string, date date, v int")
    one, two = (Partitioned(spark, str(tmp_path), monthly()) for _ in range(2))
    one.append(df)

    def meanwhile(old):
        two.merge(df.where("k = 'b'").withColumn("v", F.lit(9)), ["k"])
        return old.withColumn("v", F.lit(0))

    with pytest.raises(quality.QualityError, match="no longer"):
        one.change(["2024-01"], meanwhile)
    assert {r["k"]: r["v"] for r in one.read().collect()} == {"a": 1, "b": 9}
    held = one.read()
    assert len(one.vacuum(2)) == 1  # what the refused change wrote
    one.merge(df.where("k = 'a'").withColumn("v", F.lit(5)), ["k"])
    assert one.vacuum(1) and {r["k"]: r["v"] for r in two.read().collect()} == {"a": 5, "b": 9}
    with pytest.raises(Exception):
        held.collect()
    keys = Partitioned(spark, str(tmp_path / "buckets"), bucket("k", 4))
    keys.append(df)
    assert keys.read().count() == 2


@pytest.mark.parametrize("slot", [5, 64])
def test_synthetic_days_by_segments_are_the_sequential_fill(spark, slot):
    r = random.Random(6)
    calendar = days(160)
    rows = [(k, d, *[float(r.randrange(1, 90)) for _ in range(5)]) for k, share in (("a", 0.9), ("b", 0.4), ("c", 0.05), ("d", 1.0)) for i, d in enumerate(calendar) if r.random() < share and not (k == "a" and 60 < i < 100)]
    names = ["open", "high", "low", "close", "volume"]
    bars_ = spark.createDataFrame(rows, "commodity string, date date, " + ", ".join(f"{n} double" for n in names))
    want, have = {}, {(x[0], x[1]): list(x[2:]) for x in rows}
    for k in "abcd":
        last = []
        for d in calendar:
            now = have.get((k, d)) or ([round(sum(v[c] for v in last) / len(last), 2) for c in range(5)] if last else None)
            if now:
                want[k, d] = (now, "REAL" if (k, d) in have else "SYNTHETIC")
                last = [*last, now][-3:]
    spine = spark.createDataFrame([(d,) for d in calendar], "date date")
    got = commodity.synthetic_days(bars_, spine, slot=slot).collect()
    assert {(x["commodity"], x["date"]): ([x[n] for n in names], x["data_quality_flag"]) for x in got} == want and len(got) == len(want)
    with pytest.raises(ValueError):
        commodity.synthetic_days(bars_, spine, slot=3)


def test_loans_of_the_last_observed_month(spark):
    from riskspark.plans import q_views

    sf = "/root/testdata/sf0.001"
    assert q_views.q15_loan(spark, sf).count() > 100 and q_views.q15_ticker(spark, sf).count() == 10


@pytest.mark.parametrize("slot", [1, 7, 365])
def test_carried_values_are_those_of_one_window(spark, slot):
    r = random.Random(8)
    rows = [(k, d, None if k == "none" or r.random() < 0.85 else r.random()) for k in ("a", "b", "none", None) for d in days(60) if r.random() < 0.9]
    df = spark.createDataFrame([*rows, ("late", DAY, None), ("late", days(60)[-1], 2.0)], "k string, date date, x double")
    value, flag = W.filled(F.col("x"), W.over(["k"], "date"))
    key = lambda d: sorted(map(str, d.select("k", "date", "filled", "flag").collect()))
    assert key(filling.carried(df, F.col("x"), "k", slot=slot)) == key(df.withColumns({"filled": value, "flag": flag}))


def test_loans_roll_by_the_months_of_their_ticker(spark):
    from riskspark.plans import q_market

    months = [("a", dt.date(2024, m, 1), v) for m, v in ((1, 1.0), (2, 4.0), (3, None), (6, 2.0), (7, 9.0))] + [("b", dt.date(2024, 5, 1), 3.0)]
    monthly = spark.createDataFrame(months, "ticker string, month date, x double")
    lent = spark.createDataFrame([(k, t, dt.date(2024, m, 2), dt.date(2024, 12, 1)) for k, t, m in ((1, "a", 1), (2, "a", 5), (3, "b", 3), (4, "c", 1), (5, "a", 11))], "loan_id long, ticker string, issue_date date, maturity_date date")
    panel = loans.loan_month_panel(lent, [(loans.rolled_months(monthly, "ticker", {"x": "r"}), "ticker")], number="n")
    got = panel.select("x", loans.rolled_value("r", "n").alias("ours"), W.deviation(F.col("x"), W.over(["loan_id"], "month"), 3, 2).alias("window")).collect()
    assert len(got) == 11 + 7 + 9 + 11 + 1 and sum(r["ours"] is not None for r in got) == 4 and sum(r["x"] is not None for r in got) == 6
    assert all((r["ours"] is None) == (r["window"] is None) and (r["ours"] is None or abs(r["ours"] - r["window"]) < 1e-12) for r in got)
    plan = q_market.loan_table(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(" not in plan and "Window" not in plan, plan


def test_days_of_few_keys_fan_out_in_many_tasks(spark):
    from riskspark.operators import fx

    pairs = spark.createDataFrame([(p, d, float(k)) for p in ("A", "B") for k, d in enumerate(days(3))], "currency_pair string, date date, fx_rate double").coalesce(1)
    names = spark.createDataFrame([(f"t{k}", "AB"[k % 2]) for k in range(1000)] + [("none", "C"), ("null", None)], "ticker string, currency_pair string").coalesce(1)
    out = joins.fan_out(pairs, names, "currency_pair")
    assert sorted(map(tuple, out.select("currency_pair", "date", "fx_rate", "ticker").collect())) == sorted(map(tuple, pairs.join(names, "currency_pair").select("currency_pair", "date", "fx_rate", "ticker").collect()))
    sector_pair = spark.createDataFrame([("A", "A", 0.1), ("B", "B", 0.2)], "sector string, currency_pair string, foreign_ratio double")
    rates = pairs.select("currency_pair", "date", F.lit(1.0).alias("interest_diff"))
    for df in (out, fx.fx_features(names.withColumnRenamed("currency_pair", "sector"), pairs, rates, sector_pair)):
        made = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
        assert len(made) == 4 and max(made) < 1000 and sum(made) == 3000


def test_exposures_never_hold_days_without_a_value(spark):
    from riskspark.plans import q_more

    companies = spark.createDataFrame([(f"t{k}", "S") for k in range(5)] + [("other", "R")], "ticker string, sector string")
    weights = spark.createDataFrame([("S", "GOLD", 0.5), ("S", "OIL", 0.2), ("R", "TIN", 0.1)], "sector string, commodity string, sensitivity double")
    features = spark.createDataFrame([(c, d, 0.1 * k, 0.01) for c in ("GOLD", "OIL") for k, d in enumerate(days(4))], "commodity string, date date, vol_20d double, daily_return double")
    values = spark.createDataFrame([("t0", days(4)[1], 10.0), ("t1", days(4)[3], None), ("t1", DAY + dt.timedelta(days=99), 5.0), ("other", DAY, 1.0), ("gone", DAY, 1.0)], "ticker string, date date, mtm_value double")
    df = commodity.commodity_exposure(companies, weights, features, values)
    got = sorted((r["ticker"], r["commodity"], r["date"], r["exposure_amount"]) for r in df.collect())
    assert got == [("t0", "GOLD", days(4)[1], pytest.approx(0.5 * 10 * 0.7)), ("t0", "OIL", days(4)[1], pytest.approx(0.2 * 10 * 0.7)), ("t1", "GOLD", days(4)[3], 0.0), ("t1", "OIL", days(4)[3], 0.0)]
    chain = q_more.j10(spark, "/root/testdata/sf0.001")
    for plan in (df, chain):  # a join on ticker and date is one of all days of a commodity's tickers
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"Join \w+, \(\(?ticker#\d+ = ticker#\d+\) AND \(date", text), text


def test_models_read_weights_without_a_shuffle_of_positions(spark):
    from riskspark.plans import market

    sf = "/root/testdata/sf0.001"
    for ours, columns in ((market.equity_weights(spark, sf), ["beta_weighted", "volatility_21d"]), (market.inference_table(spark, sf), ["ret_lag1", "weight_lag_return", "market_mean", "sector_vol21"])):
        plan = ours.select("asset_manager", "ticker", "date", *columns)._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\(asset_manager#\d+, (date|ticker)", plan.split("BroadcastExchange")[0]) and not re.search(r"Window.*asset_manager", plan), plan


def test_position_weights_equal_those_of_position_risk(spark):
    from riskspark.operators import equity

    rows = [("a", "t1", DAY, 10.0, 1.0), ("a", "t2", DAY, 30.0, None), ("b", "t1", DAY, None, 2.0), (None, "t3", DAY, 5.0, 1.0), ("a", "t4", None, 7.0, 0.5), ("c", "t5", DAY, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "asset_manager string, ticker string, date date, mtm_value double, beta double")
    more = df.withColumns({c: F.lit(0.01) for c in ("daily_return", "volatility_21d", "vol_20d", "vol_5d")} | {"sector": F.lit("s"), "industry": F.lit("i")})
    columns = ["asset_manager", "ticker", "date", "portfolio_weight", "beta_weighted"]
    ours, whole = (sorted(map(str, x.select(columns).collect())) for x in (equity.position_weights(df), equity.position_risk(more)))
    assert ours == whole and len(ours) == 6


def test_large_values_are_rounded_as_in_the_sql(spark):
    import duckdb
    from riskspark.plans import query

    values = [1733093416261.557, -1733093416261.557, 922337203685.4776, 12345.67895, -12345.67895, 0.0, 4.0e15, 9.3e18, float("inf"), float("nan"), None]
    rows = spark.createDataFrame(list(enumerate(values)), "k long, x double")
    for digits in (1, 4, 8):
        got = [r["x"] for r in rows.select("k", query._cut(F.col("x"), digits).alias("x")).orderBy("k").collect()]
        want = [duckdb.execute(f"SELECT {query._cut_sql('x', str(digits))} FROM (SELECT CAST(? AS DOUBLE) AS x)", [v]).fetchone()[0] for v in values]
        assert list(map(str, got)) == list(map(str, want)), digits


def _odd_positions(spark):
    rows = [("a", f"t{k}", DAY, float(10 + k) if k % 4 else None, "s" if k % 3 else "r", f"i{k % 5}", None if k == 2 else 0.5 + k, 0.01 * k - 0.03, 100.0 * k, 50.0 + k) for k in range(9)]
    rows += [("b", "t1", DAY, 5.0, None, "i1", 1.0, None, 10.0, 0.0), ("b", "t2", DAY, 7.0, "s", None, 2.0, 0.02, 10.0, 3.0), ("b", "t3", DAY, 7.0, "s", "", 2.0, -0.02, 0.0, 3.0), ("b", "t4", DAY, 2.0, "", None, 2.0, 0.01, 0.0, 3.0)]
    rows += [("c", "t1", DAY, 4.0, "s", "i1", 1.0, 0.1, 1.0, 1.0), ("c", "t2", DAY, -4.0, "s", "i2", 1.0, 0.1, 1.0, 1.0), ("d", "t1", DAY, -4.0, "s", "i1", 1.0, 0.1, 1.0, 1.0), ("d", "t2", DAY, -1.0, "r", "i2", 1.0, 0.2, 2.0, 1.0)]
    rows += [(None, "t1", None, 3.0, "s", "i1", 1.0, 0.1, 1.0, 1.0), (None, "t2", DAY, None, "s", "i1", None, None, None, None), ("e", "t1", None, 3.0, "s", "i1", 1.0, 0.1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "asset_manager string, ticker string, date date, mtm_value double, sector string, industry string, beta double, daily_return double, volume double, shares double")
    return df.withColumns({"avg_volume_10d": F.col("volume") / 2, "volatility_21d": F.lit(None).cast("double"), "vol_20d": F.abs("daily_return"), "vol_5d": F.lit(0.02)})


def _same_rows(ours, whole, columns):
    both = [sorted(([r[k] if isinstance(r[k], str | None) else str(r[k]) if k == "date" else round(r[k], 10) + 0.0 for k in columns] for r in x.select(columns).collect()), key=str) for x in (ours, whole)]
    assert both[0] == both[1] and both[0]


def test_position_risk_from_sums_moves_no_position(spark):
    from riskspark.operators import equity
    from riskspark.plans import registry

    df = _odd_positions(spark)
    columns = ["asset_manager", "ticker", "date", "daily_pnl", "portfolio_weight", "sector_exposure", "industry_exposure", "beta_weighted", "sector_beta_weighted", "daily_VaR_95", "daily_CVaR_99"]
    _same_rows(equity.position_risk_by_sums(df), equity.position_risk(df), columns)
    plan = registry.queries()["R03_position_risk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[.*(mtm_value|portfolio_weight|beta_weighted)#", plan), plan


def test_concentration_from_sums_moves_the_largest_positions_alone(spark):
    from riskspark.operators import equity
    from riskspark.plans import registry

    df = _odd_positions(spark)
    columns = ["asset_manager", "ticker", "date", "top_5_exposure", "hhi_sector", "diversification_score", "liquidity_risk_score", "amihud_illiquidity", "turnover_ratio"]
    for per_sector in (False, True):
        whole = equity.concentration_liquidity(equity.position_risk(df), per_sector)
        _same_rows(equity.concentration_liquidity_by_sums(df, per_sector), whole, columns)
    plan = registry.queries()["R05_concentration_liquidity"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Window \[.*(sum|min|max)\((mtm_value|portfolio_weight|_weight|_amihud)#", plan), plan
    assert re.search(r"WindowGroupLimit \[asset_manager#\d+, date#\d+\].* 5", plan), plan
