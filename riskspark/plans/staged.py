"""Fixtures that several branches of a query read, worked out once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import RLock

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import tables
from riskspark.plans import fixtures as X


class Staged:
    """The functions of fixtures. Tables that aggregate line items are written at their first use and read again from then on: bars in
    buckets of tickers, with the sums that daily FX rates are made of, so that those need no scan of their own if bars are there. Others are as they are."""

    def __init__(self) -> None:
        self._made: dict[str, DataFrame] = {}
        self._locks: dict[str, RLock] = defaultdict(RLock)

    def __getattr__(self, name: str) -> Callable[..., DataFrame]:
        return getattr(X, name)

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """What make gives, from its first use on."""
        with self._locks[name]:
            if name not in self._made:
                self._made[name] = make()
            return self._made[name]

    def together(self, spark: SparkSession, *makes: Callable[[], DataFrame]) -> None:
        """Write tables side by side: their jobs share the executors, so a scan of few tasks does not hold up the others."""
        with ThreadPoolExecutor(len(makes)) as pool:
            for each in [pool.submit(inheritable_thread_target(spark)(make)) for make in makes]:
                each.result()

    def trading(self, spark: SparkSession, sf: str) -> Staged:
        """With bars, positions and commodity days made side by side."""
        self.together(spark, *[lambda f=f: f(spark, sf) for f in (self.bars_daily, self.positions, self.commodity_daily)])
        return self

    def for_trades(self, spark: SparkSession, sf: str) -> Staged:
        """With what trades of the last dates read, made side by side: no bars but the days that have one."""
        self.together(spark, *[lambda f=f: f(spark, sf) for f in (self.ticker_days, self.positions, self.commodity_daily, self.fx_daily)])
        return self

    def universe(self, spark: SparkSession, sf: str) -> DataFrame:
        """Written once, so that joins know its size."""
        return self.once("universe", lambda: tables.staged(X.universe(spark, sf)))

    def ticker_days(self, spark: SparkSession, sf: str) -> DataFrame:
        def make() -> DataFrame:
            return tables.staged(self.bars_daily(spark, sf).select("ticker", "date") if self.has_bars() else X.ticker_days(spark, sf))

        return self.once("days", make)

    def has_bars(self) -> bool:
        return "bars" in self._made

    def _bars(self, spark: SparkSession, sf: str) -> DataFrame:
        def make() -> DataFrame:
            parts = tables.parts(X.table(spark, sf, "lineitem"))
            bars = X._bars(X.by_ticker(X._trades(spark, sf), parts), "ticker", F.sum("price").alias("_total"), F.count("price").alias("_n"))
            return tables.staged(bars, "ticker", "date", parts=parts)

        return self.once("bars", make)

    def bars_daily(self, spark: SparkSession, sf: str) -> DataFrame:
        return self._bars(spark, sf).drop("_total", "_n")

    bars_by_ticker = bars_daily

    def positions(self, spark: SparkSession, sf: str) -> DataFrame:
        return self.once("positions", lambda: tables.staged(X.positions(spark, sf)))

    def fx_daily(self, spark: SparkSession, sf: str) -> DataFrame:
        def make() -> DataFrame:
            if not self.has_bars():
                return tables.staged(X.fx_daily(spark, sf, self.universe(spark, sf)))
            priced = self._bars(spark, sf).join(self.universe(spark, sf).select("ticker", "sector"), "ticker").join(X.sector_pair(spark, sf), "sector")
            return tables.staged(priced.groupBy("currency_pair", "date").agg((F.sum("_total") / F.sum("_n")).alias("fx_rate")))

        return self.once("fx", make)

    def rates(self, spark: SparkSession, sf: str) -> DataFrame:
        return X.first_rates(self.fx_daily(spark, sf))

    def commodity_daily(self, spark: SparkSession, sf: str) -> DataFrame:
        return self.once("commodity", lambda: tables.staged(X.commodity_by_ends(spark, sf), "commodity", "date"))
