"""State of the bar stream: a buffer for each key that bars are appended to, and a registry that holds the number of keys to a cap.

Both are processors on the RocksDB state store. A key's last time is a value, its bars are a list: new bars are appended, and when the list
is twice as long as the buffer needs, it is written again from its end, so a bar is written twice at most. A timer clears keys that
are idle. A table made by a batch, a row for each key, can be the state to begin with (after a restart without a checkpoint).

The registry is told by shards of keys: each knows its share of the cap, by order of admission. A new key beyond it takes the place
of the one admitted first, whose buffer a mark in the stream clears at once; an evicted key that comes back is admitted anew and starts with an empty buffer.

Order: a bar counts if it is later than all of its key that came before it. What came before is told by micro-batch and then by `order`.
With ("ts", "arrival"), bars that reach the same micro-batch are put in the order of their times first, so one that is late by less than a batch
still counts; `operators.intraday.in_order` with a column of batches, then ts, gives the same rows. With ("arrival", "ts"), where
micro-batches end makes no difference, and in_order by arrival and ts gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from riskspark.functions import windows as W
from riskspark.operators.intraday import EQUITY_METRICS, window_metrics

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR = "minute long, close double, high double, low double, volume double"
COLUMNS = ("ticker", "ts", "open", "high", "low", "close", "volume")
OUTPUT = "ticker string, ts timestamp, open double, high double, low double, close double, volume double, " + ", ".join(f"{m} double" for m in EQUITY_METRICS)
INPUT = "ticker string, ts timestamp, arrival timestamp, open double, high double, low double, close double, volume double, emit boolean"
#: Parts of the keys with registries of their own.
SHARDS = 64
#: Bars that leave a processor at once.
SLICE = 1 << 16


def use_rocksdb(spark: SparkSession) -> None:
    """The session's later streams keep their state in RocksDB, which these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _micros(times: pd.Series) -> np.ndarray:
    return times.to_numpy().astype("datetime64[us]").astype(np.int64)


class Buffers(StatefulProcessor):
    """Metrics of a key's bars over its last `rows` accepted ones."""

    def __init__(self, rows: int, minutes: Sequence[int], late: int, order: Sequence[str], idle_ms: int | None):
        self.rows, self.minutes, self.late, self.order, self.idle_ms = rows, tuple(minutes), late, list(order), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ts long, held long, epoch long, seen long")
        self.bars = handle.getListState("bars", BAR)

    def _clear(self) -> None:
        self.last.clear()
        self.bars.clear()

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState.itertuples(index=False):
            held = [(int(x["minute"]), *(None if x[c] is None else float(x[c]) for c in ("close", "high", "low", "volume"))) for x in row.bars][-self.rows :]
            self.bars.put(held)
            self._keep(int(row.last), len(held), -1, timerValues)  # any admission takes these bars over

    def _keep(self, ts: int | None, held: int, epoch: int, timers) -> None:
        now = timers.getCurrentProcessingTimeInMs() if self.idle_ms else 0
        if self.idle_ms and not self.last.exists():
            self.handle.registerTimer(now + self.idle_ms)
        self.last.update((ts, held, epoch, now))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True)
        ts, held, epoch, _ = self.last.get() if self.last.exists() else (None, 0, -1, 0)
        over = pdf.loc[pdf["ts"].isna(), "epoch"].max()
        pdf = pdf[pdf["ts"].notna()].sort_values(["epoch", *self.order], kind="stable")
        if not len(pdf):
            if epoch <= over:  # this admission is over
                self._clear()
            return
        own, at = pdf["epoch"].to_numpy(np.int64), _micros(pdf["ts"])
        if epoch not in (-1, own[0]):  # evicted meanwhile
            ts, held = None, 0
        later, now, epoch = at > self._seen(own, at, ts), own[0], int(own[-1])
        pdf, own, at = pdf[later], own[later], at[later]
        before = [tuple(b) for b in self.bars.get()][-self.rows :] if held else []
        values = [at // 60_000_000, *(pdf[c].to_numpy(float) for c in ("close", "high", "low", "volume"))]
        values = [np.concatenate([np.array([b[k] for b in before], float).astype(x.dtype), x]) for k, x in enumerate(values)]
        begins = np.concatenate([[0], 1 + np.flatnonzero(np.diff([*[now] * len(before), *own]))])  # where bars of another admission begin
        first = np.repeat(begins, np.diff([*begins, len(values[0])]))
        if len(at):
            fresh, stays = len(at), begins[-1] == 0 and 0 < held and held + len(at) <= 2 * self.rows
            if not stays:
                fresh = min(self.rows, len(values[0]) - int(begins[-1]))
            tail = [(int(m), *(None if np.isnan(x) else float(x) for x in more)) for m, *more in zip(*(x[-fresh:] for x in values), strict=True)]
            (self.bars.appendList if stays else self.bars.put)(tail)
            ts, held = int(at[-1]), held + fresh if stays else fresh
        if epoch <= over:
            self._clear()
        else:
            self._keep(ts, held, epoch, timerValues)
        shown = ((pdf["arrival"] - pdf["ts"]).dt.total_seconds().to_numpy() <= self.late * 60) & pdf["emit"].to_numpy(bool)
        for start in range(0, len(at), SLICE):
            part, here = slice(start, start + SLICE), len(before) + start
            low, high = max(0, here - self.rows + 1), len(before) + min(start + SLICE, len(at))
            found = window_metrics(*(x[low:high] for x in values), self.rows, self.minutes, np.maximum(first[low:high] - low, 0) if len(begins) > 1 else None)
            some = pd.DataFrame({c: pdf[c].iloc[part].to_numpy() for c in COLUMNS} | {m: found[m][here - low :] for m in EQUITY_METRICS})
            yield some[shown[part]]

    def _seen(self, own: np.ndarray, at: np.ndarray, ts: int | None) -> np.ndarray:
        """The latest time before each bar of its admission; the one in the state is of the first admission."""
        least = np.iinfo(np.int64).min
        seen = np.concatenate([[least], pd.Series(at).groupby(own).cummax().to_numpy()[:-1]])
        seen[1:][own[1:] != own[:-1]] = least
        return seen if ts is None else np.where(own == own[0], np.maximum(seen, ts), seen)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            seen, now = self.last.get()[3], timerValues.getCurrentProcessingTimeInMs()
            if now - seen >= self.idle_ms:
                self._clear()
            else:
                self.handle.registerTimer(seen + self.idle_ms)
        return iter([])


class Registry(StatefulProcessor):
    """Admissions of a shard's keys, at most `cap` at a time; rows leave with the number of their key's admission, evicted keys leave a mark (a null time)."""

    def __init__(self, cap: int, order: Sequence[str]):
        self.cap, self.order = cap, list(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "ticker string", "epoch long")
        self.admitted = handle.getValueState("admitted", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values([*self.order, "ticker"], kind="stable", ignore_index=True)
        known = dict(sorted(((k[0], v[0]) for k, v in self.known.iterator()), key=lambda x: x[1]))  # cap keys at most, the first admitted first
        before, admitted = dict(known), self.admitted.get()[0] if self.admitted.exists() else 0
        tickers = pdf["ticker"].to_numpy()
        starts = np.concatenate([[0], 1 + np.flatnonzero(tickers[1:] != tickers[:-1])])
        epochs, gone = [], {}  # of each run of a key's bars; the last admission that ended of each key
        for ticker in tickers[starts]:
            if ticker not in known:
                if len(known) >= self.cap:
                    first = next(iter(known))
                    gone[first] = known.pop(first)
                admitted += 1
                known[ticker] = admitted
            epochs.append(known[ticker])
        for ticker in before.keys() - known.keys():
            self.known.removeKey((ticker,))
        for ticker, epoch in known.items():
            if before.get(ticker) != epoch:
                self.known.updateValue((ticker,), (epoch,))
        self.admitted.update((admitted,))
        names = [c.split()[0] for c in INPUT.split(", ")]
        pdf["epoch"] = np.repeat(epochs, np.diff([*starts, len(pdf)]))
        for start in range(0, len(pdf), SLICE):
            yield pdf[[*names, "epoch"]].iloc[start : start + SLICE]
        if gone:
            marks = pd.DataFrame({c: [None] * len(gone) for c in names}, dtype=object)
            marks["ticker"], marks["epoch"] = list(gone), list(gone.values())
            yield marks


def admitted(bars: DataFrame, cap: int, order: Sequence[str] = ("ts", "arrival"), shards: int = SHARDS) -> DataFrame:
    """Bars with the number of their key's admission (epoch), and marks of evicted keys. At most `cap` keys are admitted at a time, an equal share in each shard."""
    shards = max(1, min(shards, cap))
    return bars.withColumn("_shard", F.pmod(F.xxhash64("ticker"), F.lit(shards)).cast("int")).groupBy("_shard").transformWithStateInPandas(Registry(cap // shards, order), f"{INPUT}, epoch long", "append", "None")


def initial_state(history: DataFrame, rows: int) -> DataFrame:
    """A row for each key of a table of bars: the last time and the last `rows` bars, one a time, in order."""
    bars = history.select("ticker", F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("close", "high", "low", "volume")]).dropDuplicates(["ticker", "ts"])
    last = bars.withColumn("_n", F.row_number().over(W.over(["ticker"], F.desc("ts")))).where(F.col("_n") <= rows)
    micros = F.unix_micros("ts")
    bar = F.struct(micros.alias("at"), F.floor(micros / 60_000_000).cast("long").alias("minute"), "close", "high", "low", "volume")
    held = F.transform(F.sort_array(F.collect_list(bar)), lambda x: F.struct(*[x[c].alias(c) for c in ("minute", "close", "high", "low", "volume")]))
    return last.groupBy("ticker").agg(F.max(micros).alias("last"), held.alias("bars"))


def buffered(bars: DataFrame, rows: int, minutes: Sequence[int], late: int, order: Sequence[str], idle_ms: int | None = None, cap: int | None = None, initial: DataFrame | None = None, shards: int = SHARDS) -> DataFrame:
    """OUTPUT of a stream of INPUT rows. initial: from initial_state()."""
    use_rocksdb(bars.sparkSession)
    bars = bars.withColumn("epoch", F.lit(0).cast("long")) if cap is None else admitted(bars, cap, order, shards)
    state = {} if initial is None else {"initialState": initial.groupBy("ticker")}
    return bars.groupBy("ticker").transformWithStateInPandas(Buffers(rows, minutes, late, order, idle_ms), OUTPUT, "append", "ProcessingTime" if idle_ms else "None", **state)
