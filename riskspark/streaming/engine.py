"""Intraday metrics over a stream: an order guard and a bounded buffer for each key, late rows kept but not emitted.

A row counts only if it is later than all accepted ones of its key. A late row, one whose arrival is more than `late` minutes
after its time, still enters the buffer (later metrics need it), but nothing is emitted for it; a watermark would drop it.
Buffers lie in the state store (stateful.py), so a lost executor loses nothing. A batch that is tried again overwrites what it wrote before."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskspark.functions import scalars as S
from riskspark.operators.filters import bar_error
from riskspark.operators.intraday import MINUTES, ROWS, latest_snapshot
from riskspark.operators.partitioned import Partitioned, bucket
from riskspark.operators.tables import dead_letters, hourly
from riskspark.streaming import stateful

#: Minutes of recovery after a restart, and the session in New York, as minutes of a day.
RECOVERY, OPEN, CLOSE = 15, 9 * 60 + 30, 16 * 60


def metrics_stream(
    bars: DataFrame, rows: int = ROWS, minutes: tuple[int, int, int] = MINUTES, late: int = 5, history: DataFrame | None = None, idle: str | None = None, order: tuple[str, ...] = ("ts", "arrival"), cap: int | None = None, initial: DataFrame | None = None, shards: int = stateful.SHARDS
) -> DataFrame:
    """Metrics of a stream of valid bars (ticker, ts, arrival, open, high, low, close, volume).

    For a start without a checkpoint the buffers are filled with bars for which nothing is emitted: initial is a batch of bars, the state to
    begin with; history is a stream of them. Both come from recovery_rows(). idle: a timer clears a key without bars for so long ("2 days"); such a
    query looks for idle keys without end, so bounded runs leave it out. cap: so many keys have a buffer at most. order: see stateful.py."""
    time = lambda c: F.col(c).cast("timestamp").alias(c)
    own = lambda df, emit: df.select("ticker", time("ts"), time("arrival"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")], F.lit(emit).alias("emit"))
    df = own(bars, True) if history is None else own(history, False).unionByName(own(bars, True))
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    return stateful.buffered(df, rows, minutes, late, order, idle_ms, cap, None if initial is None else stateful.initial_state(initial, rows), shards)


def recovery_rows(history: DataFrame, start: dt.datetime, minutes: int = RECOVERY, opens: int = OPEN, closes: int = CLOSE) -> DataFrame:
    """Raw bars of the last minutes before a start, of its New York session only; none in the first minutes of a session, which
    has nothing to recover. For batches and streams."""
    begin, minute_of = F.lit(start).cast("timestamp"), lambda t: F.hour(t) * 60 + F.minute(t)
    at, now = S.eastern(F.col("ts")), S.eastern(begin)
    recent = (F.col("ts") < begin) & (F.unix_micros(begin) - F.unix_micros(F.col("ts").cast("timestamp")) <= minutes * 60_000_000)
    session = (F.to_date(at) == F.to_date(now)) & (minute_of(at) >= opens) & (minute_of(at) < closes) & (minute_of(now) >= opens + minutes)
    return history.where(recent & session)


def deduplicated(bars: DataFrame, key: str = "ticker", ts: str = "ts", keep: str = "1 hour") -> DataFrame:
    """One bar of a key and time; the state of times older than `keep` is dropped."""
    return bars.withWatermark(ts, keep).dropDuplicatesWithinWatermark([key, ts])


def run(df: DataFrame, path: str, checkpoint: str, mode: str = "live", **lineage) -> StreamingQuery:
    """Write a stream by batch, New York date and hour under its mode, with dead letters and the latest row of each key beside it. Backfills
    process what is there and stop."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.withColumn("error", bar_error()).persist()
        try:
            good, dead = dead_letters(batch, "ticker", str(batch_id), lineage.get("run_id", ""), mode)
            good = good.withColumns({k: F.lit(v) for k, v in lineage.items()})
            hourly(good).write.partitionBy("date", "hour").mode("overwrite").parquet(f"{path}/bars/{mode}/batch_id={batch_id}")
            dead.drop("batch_id").write.mode("overwrite").parquet(f"{path}/dead/{mode}/batch_id={batch_id}")
            count(batch).write.mode("overwrite").parquet(f"{path}/counters/{mode}/batch_id={batch_id}")
            keep_latest(good, f"{path}/latest/{mode}")
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer if mode == "live" else writer.trigger(availableNow=True)).start()


def count(batch: DataFrame, key: str = "ticker", ts: str = "ts", late: int = 5) -> DataFrame:
    """One row of counters of a batch with errors marked: received, failed, processed, late (if rows tell their arrival) and deduped (beyond the first of a key and time)."""
    behind = F.unix_micros(F.col("arrival").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp")) > late * 60_000_000 if "arrival" in batch.columns else F.lit(False)
    each = batch.groupBy(key, ts).agg(F.count("*").alias("n"), F.count("error").alias("bad"), F.count_if(behind).alias("late"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return each.agg(total("n").alias("received"), total("bad").alias("failed"), total(F.col("n") - F.col("bad")).alias("processed"), total("late").alias("late"), total(F.col("n") - 1).alias("deduped"), F.current_timestamp().alias("at"))


def counters(spark, path: str, mode: str = "live") -> DataFrame:
    """The counters that run() kept, by batch_id."""
    return spark.read.parquet(f"{path}/counters/{mode}")


def _latest(spark, path: str, key: str, ts: str) -> Partitioned:
    return Partitioned(spark, path, bucket(key), ts)


def keep_latest(batch: DataFrame, path: str, key: str = "ticker", ts: str = "ts") -> None:
    """Merge a batch into the table of the last row of every key ever seen; the same batch twice changes nothing. Only the buckets of the batch's keys are written again."""
    table = _latest(batch.sparkSession, path, key, ts)

    def newest(old: DataFrame | None) -> DataFrame:
        rows = batch if old is None else old.unionByName(batch, allowMissingColumns=True)
        return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), ts).alias("_row")).select(key, "_row.*")

    table.change(table.parts_of(batch), newest)
    table.vacuum(2)


def snapshot(spark, path: str, now: dt.datetime | None = None, stale_minutes: int = 5, key: str = "ticker", ts: str = "ts") -> DataFrame | None:
    """The last row of every key ever seen, with is_stale against now, or the newest row."""
    rows = _latest(spark, path, key, ts).read()
    return rows if rows is None else latest_snapshot(rows, key, ts, stale_minutes, None if now is None else F.lit(now).cast("timestamp"))


def counted(df: DataFrame, name: str = "bars") -> DataFrame:
    """The frame with counters of received, invalid and late rows, told to query listeners with each batch."""
    late = F.unix_micros(F.col("arrival").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > 300_000_000
    return df.observe(name, F.count(F.lit(1)).alias("received"), F.count_if(bar_error().isNotNull()).alias("failed"), F.count_if(late).alias("late"))
