"""Queries that write a sink or run a stream and read back what is there (S, K, ST), on whole tables.

Each run has a folder of its own in the shared folder; W23 and F12 stand here with SQL over all rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars
from riskspark.operators import commodity, tables
from riskspark.operators.partitioned import Partitioned, monthly
from riskspark.plans import fixtures as X
from riskspark.plans import q_serving as S
from riskspark.plans.query import query
from riskspark.sources import scans
from riskspark.streaming import engine


def _place(spark) -> str:
    return f"{tables.shared_folder(spark)}/{uuid.uuid4().hex}"


@query("S03_replay_rows", "event_id copies topic", "SELECT event_id, 2 AS copies, CAST(NULL AS VARCHAR) AS topic FROM events")
def s03(spark, sf):
    return scans.replay(spark, [f"{sf}/events.parquet", f"{sf}/events.parquet"]).groupBy("event_id", "topic").agg(F.count("*").alias("copies"))


@query("S04_newest_rows", "ticker event_id", "SELECT ticker, event_id FROM ticks WHERE event_id % 2 = 1")
def s04(spark, sf):
    place, t = _place(spark), X.ticks(spark, sf)
    for part in (0, 1):  # a file for each instrument and write
        t.where(F.col("event_id") % 2 == part).repartition("ticker").write.partitionBy("ticker").mode("append").parquet(place)
    return scans.newest_files(spark, place, ["ticker"])


@query("S08_day_first_rows", "o_orderkey day", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def s08(spark, sf):
    place = _place(spark)
    X.table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd-MM-yyyy").alias("day")).write.csv(place, header=True)
    return scans.day_first_csv(spark, place, "o_orderkey long, day date")


@query("S09_watermark_rows", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def s09(spark, sf):
    return scans.after(X.table(spark, sf, "orders"), F.to_timestamp(F.lit("1998-01-01")), "o_orderdate").select("o_orderkey")


@query("S10_from_month_rows", "o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'")
def s10(spark, sf):
    return scans.from_month(X.table(spark, sf, "orders"), "1998-03-17", "o_orderdate").select("o_orderkey")


_ET = "timezone('America/New_York', timezone('UTC', ts))"


@query("K01_hourly_sink", "event_id mode date hour", f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'live' ELSE 'backfill' END AS mode, CAST({_ET} AS DATE) AS date, hour({_ET}) AS hour FROM ticks")
def k01(spark, sf):
    place, t = _place(spark), X.ticks(spark, sf)
    tables.append_hourly(t.where("event_id % 3 = 0"), place, "live")
    tables.append_hourly(t.where("event_id % 3 <> 0"), place, "backfill")
    read = lambda mode: spark.read.parquet(f"{place}/{mode}").select("event_id", F.lit(mode).alias("mode"), "date", "hour")
    return read("live").unionByName(read("backfill"))


@query("K02_dead_letter_rows", "key error original_id", "SELECT ticker AS key, CASE WHEN close <= 0 THEN 'close is not positive' ELSE 'high is below low' END AS error, event_id AS original_id FROM dirty_ticks WHERE close <= 0 OR high < low")
def k02(spark, sf):
    from riskspark.operators.filters import bar_error

    place = _place(spark)
    _, dead = tables.dead_letters(X.dirty_ticks(spark, sf).withColumn("error", bar_error()), "ticker", "b1", "r1", "replay")
    dead.write.parquet(place)
    return spark.read.parquet(place).select("key", "error", F.get_json_object("original", "$.event_id").cast("long").alias("original_id"))


_MONTHS = "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS date, max(close) AS close FROM bars_daily GROUP BY 1, 2"


def _months(spark, sf) -> DataFrame:
    """The highest close of each name and month; a month is a date of the layer."""
    return X.bars_daily(spark, sf).groupBy("ticker", F.trunc("date", "month").alias("date")).agg(F.max("close").alias("close")).repartition("date")


@query("K04_raw_runs", "ticker date close:4 run_id", f"SELECT ticker, date, CASE WHEN date >= DATE '2000-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN date >= DATE '2000-01-01' THEN 'b' ELSE 'a' END AS run_id FROM ({_MONTHS})")
def k04(spark, sf):
    place, rows = _place(spark), _months(spark, sf)
    tables.write_run(rows, place, "a")
    tables.write_run(rows.where("date >= '2000-01-01'").withColumn("close", F.col("close") + 1), place, "b")
    return scans.newest_runs(spark.read.parquet(place))


@query("K05_latest_pointer", "ticker date close:4 run_id", f"SELECT ticker, date, CASE WHEN date >= DATE '2000-01-01' THEN close + 1 ELSE close END AS close, CASE WHEN date >= DATE '2000-01-01' THEN 'a2' ELSE 'b1' END AS run_id FROM ({_MONTHS})")
def k05(spark, sf):
    layer, rows = tables.Runs(spark, _place(spark)), _months(spark, sf)
    layer.write(rows, "b1")
    layer.write(rows.where("date >= '2000-01-01'").withColumn("close", F.col("close") + 1), "a2")
    return layer.read()


@query("K07_history_rows", "ticker date run_mode", "SELECT ticker, date, unnest(['daily', 'backfill']) AS run_mode FROM bars_daily")
def k07(spark, sf):
    place = _place(spark)
    for mode in ("daily", "backfill"):
        tables.with_run_mode(X.bars_daily(spark, sf), mode).write.mode("append").parquet(place)
    return spark.read.parquet(place)


def _after(change: Callable[[Partitioned, DataFrame], None]):
    """The table by months after a change was written to it, of the bars before 2000 and newer ones with another close."""

    def build(spark, sf):
        old, new = S._split(spark, sf)
        table = Partitioned(spark, _place(spark), monthly())
        table.append(old)
        change(table, new)
        table.vacuum(1)
        return table.read()

    return build


_NEWER = "CASE WHEN date >= DATE '1999-12-01' THEN close + 1 ELSE close END AS close"
for _name, _sql, _change in (
    ("K06_rolling_written", f"SELECT ticker, date, {_NEWER} FROM bars_daily WHERE date IN (SELECT DISTINCT date FROM bars_daily ORDER BY date DESC LIMIT 30)", lambda table, new: table.roll(new, ["ticker", "date"], 30)),
    ("K08_window_written", f"SELECT ticker, date, {_NEWER} FROM bars_daily WHERE date <= DATE '1999-12-31'", lambda table, new: table.replace_dates(new.where("date <= '1999-12-31'"), "1999-12-01", "1999-12-31")),
    ("K09_merge_written", f"SELECT ticker, date, {_NEWER} FROM bars_daily", lambda table, new: table.merge(new, ["ticker", "date"])),
    ("K11_clean_written", "SELECT ticker, date, close FROM bars_daily WHERE date < DATE '1999-12-01'", lambda table, new: table.clean_write(new.limit(0), "backfill", ["ticker", "date"], "1999-12-01", "1999-12-31")),
    ("K12_months_written", f"SELECT ticker, date, {_NEWER} FROM bars_daily WHERE date < DATE '2000-01-01'", lambda table, new: table.replace_months(new.where("date < '2000-01-01'"))),
    ("K13_from_month_written", f"SELECT ticker, date, {_NEWER} FROM bars_daily", lambda table, new: table.replace_dates(new, "1999-12-01")),
    ("K14_serving_written", "SELECT ticker, date, close + 1 AS close FROM bars_daily WHERE date IN (SELECT DISTINCT date FROM bars_daily ORDER BY date DESC LIMIT 2)", lambda table, new: table.serve(new)),
):
    query(_name, "ticker date close:4", _sql)(_after(_change))


def _stream(spark, rows: DataFrame) -> DataFrame:
    """Rows as a stream of files."""
    place = _place(spark)
    rows.write.parquet(place)
    return spark.readStream.schema(rows.schema).parquet(place)


#: Rows of a micro-batch, about; a processor holds a batch's rows of a key at once.
BATCH = 2_000_000


def _in_batches(spark, rows: DataFrame) -> DataFrame:
    """Rows as a stream in the order of their times, one file a micro-batch: files come in the order of their writing, so each range of times is written after those before it."""
    parts = -(-rows.count() // BATCH)
    if parts <= 1:
        return _stream(spark, rows)
    ranges, place = _place(spark), _place(spark)
    rows.repartitionByRange(parts, "ts").withColumn("part", F.spark_partition_id()).write.partitionBy("part").parquet(ranges)
    staged = spark.read.schema(rows.withColumn("part", F.lit(0)).schema).parquet(ranges)
    for k in range(parts):
        staged.where(F.col("part") == k).drop("part").coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)


def _emitted(stream: DataFrame, place: str) -> DataFrame:
    stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/ck").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{place}/out")


def _metrics(spark, sf, late) -> DataFrame:
    """What the stream of ticks emits, each `late` of them arriving an hour after its time."""
    place = _place(spark)
    t = X.ticks(spark, sf).withColumn("arrival", F.when(late, F.expr("ts + interval 1 hour")).otherwise(F.col("ts")))
    return _emitted(engine.metrics_stream(_in_batches(spark, t), minutes=S._MIN), place)


_BEFORE = "SELECT ticker, event_id, ts, close - lag(close) OVER (PARTITION BY ticker ORDER BY ts) AS close_diff, close FROM (SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id) = 1)"


@query("ST06_stream_metrics", "ticker ts close_diff:5", _BEFORE)
def st06(spark, sf):
    return _metrics(spark, sf, F.lit(False))


_DISTINCT = "(SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY ticker, ts ORDER BY event_id) = 1)"
_ALL = S.W24_SQL.replace("FROM ticks t", f"FROM {_DISTINCT} t")


@query("ST06_stream_all_metrics", f"ticker ts {S.W24_COLUMNS}", f"SELECT m.*, ts FROM ({_ALL}) m JOIN ticks USING (event_id)")
def st06_all(spark, sf):
    return _metrics(spark, sf, F.lit(False))


@query("ST08_restarted", f"ticker ts {S.W24_COLUMNS}", f"SELECT m.*, ts FROM ({_ALL}) m JOIN ticks USING (event_id) WHERE ts >= TIMESTAMP '2024-01-15'")
def st08(spark, sf):
    """A start without a checkpoint, with the ticks before it as the state to begin with, emits what an unbroken run does."""
    place, t = _place(spark), X.ticks(spark, sf).withColumn("arrival", F.col("ts"))
    stream = engine.metrics_stream(_in_batches(spark, t.where("ts >= '2024-01-15'")), minutes=S._MIN, initial=t.where("ts < '2024-01-15'"))
    return _emitted(stream, place)


@query("ST09_one_key", "ticker ts close_diff:5", f"SELECT ticker, ts, close - lag(close) OVER (PARTITION BY ticker, n - m ORDER BY ts) AS close_diff FROM (SELECT *, row_number() OVER (ORDER BY ts, ticker) AS n, row_number() OVER (PARTITION BY ticker ORDER BY ts) AS m FROM {_DISTINCT})")
def st09(spark, sf):
    """With a cap of one key, each change of keys evicts: buffers hold a run of ticks of one key."""
    t = X.ticks(spark, sf).withColumn("arrival", F.col("ts"))
    return _emitted(engine.metrics_stream(_in_batches(spark, t), minutes=S._MIN, cap=1), _place(spark))


@query("ST11_counters_kept", "received failed processed late deduped", "SELECT count(*) AS received, count(*) FILTER (bad) AS failed, count(*) FILTER (NOT bad) AS processed, count(*) FILTER (late) AS late, count(*) - count(DISTINCT (ticker, ts)) AS deduped FROM (SELECT *, close <= 0 OR high < low AS bad, arrival - epoch_us(ts) > 300000000 AS late FROM dirty_ticks)")
def st11(spark, sf):
    kept = engine.counters(spark, _backfilled(spark, sf), "backfill")
    return kept.agg(*[F.sum(c).alias(c) for c in ("received", "failed", "processed", "late", "deduped")])


@query("ST05_stream_late", "ticker ts close_diff:5", f"SELECT * FROM ({_BEFORE}) WHERE event_id % 23 <> 0")
def st05(spark, sf):
    return _metrics(spark, sf, F.col("event_id") % 23 == 0)


def _backfilled(spark, sf) -> str:
    place = _place(spark)
    engine.run(_stream(spark, X.dirty_ticks(spark, sf).withColumn("arrival", F.timestamp_micros("arrival"))), f"{place}/out", f"{place}/ck", "backfill", run_id="r1").awaitTermination()
    return f"{place}/out"


@query("ST02_backfill_run", "side ticker event_id run_id", "SELECT CASE WHEN close <= 0 OR high < low THEN 'dead' ELSE 'bars' END AS side, ticker, event_id, 'r1' AS run_id FROM dirty_ticks")
def st02(spark, sf):
    out = _backfilled(spark, sf)
    bars = spark.read.parquet(f"{out}/bars/backfill").select(F.lit("bars").alias("side"), "ticker", "event_id", "run_id")
    dead = spark.read.parquet(f"{out}/dead/backfill").select(F.lit("dead").alias("side"), F.col("key").alias("ticker"), F.get_json_object("original", "$.event_id").cast("long").alias("event_id"), "run_id")
    return bars.unionByName(dead)


@query("ST07_latest_rows", "ticker event_id is_stale", "SELECT ticker, event_id, epoch_us((SELECT max(ts) FROM dirty_ticks WHERE NOT (close <= 0 OR high < low))) - epoch_us(ts) > 30 * 60000000 AS is_stale FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ts DESC) AS r FROM dirty_ticks WHERE NOT (close <= 0 OR high < low)) WHERE r = 1")
def st07(spark, sf):
    return engine.snapshot(spark, f"{_backfilled(spark, sf)}/latest/backfill", stale_minutes=30)


_FILL = """WITH RECURSIVE spine AS (SELECT commodity, date, row_number() OVER (PARTITION BY commodity ORDER BY date) AS n, close, volume FROM (SELECT DISTINCT commodity FROM commodity_gapped) CROSS JOIN (SELECT DISTINCT date FROM commodity_daily) LEFT JOIN commodity_gapped USING (commodity, date)),
fill AS (SELECT commodity, date, n, close, volume, close IS NULL AS made, CASE WHEN close IS NULL THEN CAST([] AS DOUBLE[]) ELSE [close] END AS hc, CASE WHEN close IS NULL THEN CAST([] AS DOUBLE[]) ELSE [CAST(volume AS DOUBLE)] END AS hv FROM spine WHERE n = 1
UNION ALL SELECT commodity, date, n, c, v, made, CASE WHEN c IS NULL THEN hc ELSE list_append(hc, c)[-3:] END, CASE WHEN c IS NULL THEN hv ELSE list_append(hv, v)[-3:] END FROM (SELECT s.commodity, s.date, s.n, s.close IS NULL AS made, hc, hv, coalesce(s.close, CAST(format('{:.2f}', list_sum(hc) / nullif(len(hc), 0)) AS DOUBLE)) AS c, CASE WHEN s.close IS NULL THEN CAST(format('{:.2f}', list_sum(hv) / nullif(len(hv), 0)) AS DOUBLE) ELSE CAST(s.volume AS DOUBLE) END AS v FROM fill JOIN spine s ON s.commodity = fill.commodity AND s.n = fill.n + 1))
SELECT commodity, date, close, volume, CASE WHEN made THEN 'SYNTHETIC' ELSE 'REAL' END AS data_quality_flag FROM fill WHERE close IS NOT NULL"""


@query("W23_sequential_fill", "commodity date close:2 volume:2 data_quality_flag", _FILL)
def w23(spark, sf):
    return commodity.synthetic_days(X.commodity_gapped(spark, sf), X.commodity_daily(spark, sf).select("date").distinct())


_Z = "(close - open) / close"


@query("F12_densities", "ticker date z05:6 z01:6 density:6", f"SELECT ticker, date, -1.6448536269514722 * abs({_Z}) AS z05, -2.3263478740408408 * abs({_Z}) AS z01, exp(-({_Z}) * ({_Z}) / 2) / sqrt(2 * pi()) AS density FROM bars_daily")
def f12(spark, sf):
    z = F.expr(_Z)
    return X.bars_daily(spark, sf).select("ticker", "date", (scalars.Z_05 * F.abs(z)).alias("z05"), (scalars.Z_01 * F.abs(z)).alias("z01"), scalars.densities(z).alias("density"))
