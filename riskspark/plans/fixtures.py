"""Market tables derived from the given order, part and event tables, in Spark and as SQL.

Everything grows with its source: a supplier is a ticker, a line item a trade, an event a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.operators import tables

#: A currency pair and a foreign revenue share for each sector.
SECTOR_PAIRS = (("AFRICA", "USDZAR", 0.35), ("AMERICA", "USDCAD", 0.25), ("ASIA", "USDJPY", 0.45), ("EUROPE", "EURUSD", 0.4), ("MIDDLE EAST", "USDAED", 0.3))
#: Weights of commodities for each sector.
SECTOR_COMMODITIES = (("AFRICA", "ECONOMY", 0.3), ("AFRICA", "PROMO", 0.2), ("AMERICA", "STANDARD", 0.25), ("AMERICA", "LARGE", 0.15), ("ASIA", "MEDIUM", 0.35), ("EUROPE", "SMALL", 0.2), ("EUROPE", "ECONOMY", 0.1))
RATINGS = ("AAA", "AA+", "AA", "AA-", "A+", "A", "A-", "BBB+", "BBB", "BBB-", "BB", "B", "CCC")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _bars(trades: DataFrame, key: str, *more: Column) -> DataFrame:
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return trades.groupBy(key, "date").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").alias("volume"), *more
    )


def by_ticker(trades: DataFrame, parts: int | None = None) -> DataFrame:
    """What bars need of line items, dealt by ticker before they are added up: a bar has hardly more than one of them, so sums before the shuffle would only make rows
    wider, and windows by ticker need no other shuffle. parts: tables.parts(), so that a task's share does not grow with the table."""
    trades = trades.select("l_suppkey", "date", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity").withColumn("ticker", F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))).drop("l_suppkey")
    return tables.dealt(trades, parts, "ticker").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumns({"ticker": F.concat(F.lit("S"), F.col("l_suppkey").cast("string")), "date": F.to_date("l_shipdate"), "price": F.col("l_extendedprice") / F.col("l_quantity")})


def bars_daily(spark: SparkSession, sf: str) -> DataFrame:
    return bars_by_ticker(spark, sf)


def bar_dates(spark: SparkSession, sf: str) -> DataFrame:
    """The dates of bars: those of line items."""
    return _trades(spark, sf).select("date").distinct()


def ticker_days(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """(ticker, date) of each bar, from these two columns of line items alone; dealt by ticker, or by both for a join on both."""
    return tables.dealt(_trades(spark, sf).select("ticker", "date"), tables.parts(table(spark, sf, "lineitem")), *(by or ("ticker",))).distinct()


def bars_from(spark: SparkSession, sf: str, first: DataFrame) -> DataFrame:
    """bars_daily of tickers from a date on, and those without a date where these are asked for too: first (ticker, _first, _undated). Other line items are left at the scan."""
    kept = _trades(spark, sf).join(first, "ticker").where(F.coalesce(F.col("date") >= F.col("_first"), F.col("_undated") & F.col("date").isNull()))
    return _bars(by_ticker(kept), "ticker")


def bars_since(spark: SparkSession, sf: str, when: Column) -> DataFrame:
    """bars_daily of the dates of a condition, which is met at the scan."""
    return _bars(by_ticker(_trades(spark, sf).where(when)), "ticker")


def bars_by_ticker(spark: SparkSession, sf: str, tickers: DataFrame | None = None) -> DataFrame:
    """bars_daily for windows by ticker; or those of some tickers (ticker), whose line items alone are dealt."""
    trades = _trades(spark, sf)
    return _bars(by_ticker(trades if tickers is None else trades.join(tickers, "ticker", "left_semi"), tables.parts(table(spark, sf, "lineitem"))), "ticker")


def universe(spark: SparkSession, sf: str) -> DataFrame:
    s, n, r = (table(spark, sf, x) for x in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("r_name").alias("sector"), F.col("n_name").alias("industry"), (1e6 + 100 * F.abs("s_acctbal")).alias("revenue"))


def positions(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    owned = o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_mktsegment")  # orders meet customers first, so line items are dealt once
    joined = _trades(spark, sf).join(owned, F.col("l_orderkey") == owned.o_orderkey)
    return joined.groupBy("ticker", F.col("c_mktsegment").alias("asset_manager")).agg(F.sum("l_quantity").alias("shares"))


def fundamentals(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    size, k = F.abs("s_acctbal"), F.col("s_suppkey")
    debt = F.when(k % 10 == 0, F.lit(0.0)).when(k % 10 == 1, F.lit(None).cast("double")).otherwise(2e5 + 50 * size)
    return s.select(
        F.concat(F.lit("S"), k.cast("string")).alias("ticker"),
        (1e6 + 300 * size).alias("total_assets"),
        debt.alias("total_debt"),
        (0.6 * debt).alias("long_term_debt"),
        (1e5 + 20 * size).alias("ebitda"),
        (5e4 + 10 * F.col("s_acctbal")).alias("net_income"),
        (1e6 + 500 * size).alias("market_cap"),
        (0.5 + (k % 7) / 5.0).alias("beta"),
        (1e6 + 100 * size).alias("revenue"),
    )


def macro(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.groupBy(F.trunc("o_orderdate", "month").alias("month")).agg((F.sum("o_totalprice") / 1e6).alias("gdp"), (4 + F.avg(F.col("o_custkey") % 5)).alias("unrate"), F.count("*").cast("double").alias("cpi"), (F.avg("o_totalprice") / 1e5).alias("fedfunds"))


def sector_pair(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(SECTOR_PAIRS), "sector string, currency_pair string, foreign_ratio double")


def sector_commodity(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame(list(SECTOR_COMMODITIES), "sector string, commodity string, sensitivity double")


def fx_daily(spark: SparkSession, sf: str, names: DataFrame | None = None) -> DataFrame:
    names = universe(spark, sf) if names is None else names
    priced = _trades(spark, sf).join(names.select("ticker", "sector"), "ticker").join(sector_pair(spark, sf), "sector")
    return priced.groupBy("currency_pair", "date").agg(F.avg("price").alias("fx_rate"))


def rates(spark: SparkSession, sf: str) -> DataFrame:
    return first_rates(fx_daily(spark, sf))


def first_rates(fx: DataFrame) -> DataFrame:
    """An interest difference on the first date of each month."""
    firsts = fx.groupBy("currency_pair", F.trunc("date", "month").alias("_m")).agg(F.min_by("fx_rate", "date").alias("_rate"), F.min("date").alias("date"))
    return firsts.select("currency_pair", "date", ((F.col("_rate") - 1500) / 500).alias("interest_diff"))


def commodity_daily(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("commodity"))
    return _bars(_trades(spark, sf).join(p, F.col("l_partkey") == p.p_partkey), "commodity")


def commodity_by_ends(spark: SparkSession, sf: str) -> DataFrame:
    """commodity_daily, without putting line items in order: few commodities have few days with many items each. The first and last order of a day are numbers, found while
    the items are added up; only items of such orders are put in order."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("commodity"))
    named = lambda df: df.join(p, F.col("l_partkey") == p.p_partkey)
    trades = _trades(spark, sf).withColumn("_order", F.coalesce("l_orderkey", F.lit(-(1 << 63))))  # an item without an order comes first
    sums = [F.max("price").alias("high"), F.min("price").alias("low"), F.sum("l_quantity").alias("volume"), F.min("_order").alias("_first"), F.max("_order").alias("_last")]
    days = tables.staged(named(trades).groupBy("commodity", "date").agg(*sums))
    ends = days.select(F.col("date").alias("_day"), F.explode(F.array("_first", "_last")).alias("_end")).distinct()  # two rows for each commodity and day at most
    kept = trades.join(F.broadcast(ends), F.col("date").eqNullSafe(F.col("_day")) & (F.col("_order") == F.col("_end")), "left_semi")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    edges = named(kept).groupBy(F.col("commodity").alias("_key"), F.col("date").alias("_day")).agg(F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"))
    df = days.join(edges, F.col("commodity").eqNullSafe(F.col("_key")) & F.col("date").eqNullSafe(F.col("_day")))
    return df.select("commodity", "date", "open", "high", "low", "close", "volume")


def commodity_gapped(spark: SparkSession, sf: str) -> DataFrame:
    return commodity_daily(spark, sf).where(F.dayofyear("date") % 11 != 0)


def bond_universe(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    rating = F.element_at(F.array(*map(F.lit, RATINGS)), (k % 13 + 1).cast("int"))
    return table(spark, sf, "part").select(
        F.concat(F.lit("B"), k.cast("string")).alias("bond_id"),
        F.concat(F.lit("S"), (k % 10).cast("string")).alias("ticker"),
        rating.alias("credit_rating"),
        (F.col("p_size") / 10.0).alias("coupon_rate"),
        (1 + F.col("p_size") % 30).alias("maturity_years"),
        (80 + F.col("p_retailprice") % 40).alias("price"),
        (1000 + k % 500).alias("units_issued"),
        (800 + k % 200).alias("units_outstanding"),
    )


def loans(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    issue = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(
        F.concat(F.lit("L"), k.cast("string")).alias("loan_id"),
        F.concat(F.lit("S"), (k % 10).cast("string")).alias("ticker"),
        issue.alias("issue_date"),
        F.add_months(issue, (3 + k % 36).cast("int")).alias("maturity_date"),
        F.col("o_totalprice").alias("notional_usd"),
        ((2 + k % 7) / 100.0).alias("coupon_rate"),
        (100 + k % 300).cast("double").alias("spread_bps"),
    )


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("ticker"), "event_id", F.col("ts").cast("timestamp").alias("ts"), v.alias("open"), (v * 1.01).alias("high"), (v * 0.99).alias("low"), v.alias("close"), F.get_json_object("props", "$.k").cast("int").cast("double").alias("volume")
    )


def dirty_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Ticks with repeats, late copies, prices that are not positive, and highs under lows."""
    t, k = ticks(spark, sf).withColumn("arrival", F.unix_micros("ts")), F.col("event_id")
    t = t.withColumn("close", F.when(k % 29 == 0, -F.col("close")).otherwise(F.col("close"))).withColumn("high", F.when(k % 31 == 0, F.col("low") - 1).otherwise(F.col("high")))
    late = t.where(k % 23 == 0).withColumn("arrival", F.col("arrival") + 3_600_000_000)
    return t.unionByName(t.where(k % 17 == 0)).unionByName(late)


_ORDER = "l_orderkey, l_linenumber, l_partkey, l_extendedprice"
_BAR = f"first(price ORDER BY {_ORDER}) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY {_ORDER}) AS close, sum(l_quantity) AS volume"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(x) for x in r) + ")" for r in rows)


#: The same tables as DuckDB expressions; a name stands before those that use it.
CTES: dict[str, str] = {
    "trades": "SELECT *, 'S' || l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price FROM lineitem",
    "bars_daily": f"SELECT ticker, date, {_BAR} FROM trades GROUP BY ticker, date",
    "universe": "SELECT 'S' || s_suppkey AS ticker, r_name AS sector, n_name AS industry, 1e6 + 100 * abs(s_acctbal) AS revenue FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "positions": "SELECT ticker, c_mktsegment AS asset_manager, sum(l_quantity) AS shares FROM trades JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "debts": "SELECT *, abs(s_acctbal) AS size, CASE WHEN s_suppkey % 10 = 0 THEN 0.0 WHEN s_suppkey % 10 = 1 THEN NULL ELSE 2e5 + 50 * abs(s_acctbal) END AS debt FROM supplier",
    "fundamentals": "SELECT 'S' || s_suppkey AS ticker, 1e6 + 300 * size AS total_assets, debt AS total_debt, 0.6 * debt AS long_term_debt, 1e5 + 20 * size AS ebitda, 5e4 + 10 * s_acctbal AS net_income, 1e6 + 500 * size AS market_cap, 0.5 + (s_suppkey % 7) / 5.0 AS beta, 1e6 + 100 * size AS revenue FROM debts",
    "macro": "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) / 1e6 AS gdp, 4 + avg(o_custkey % 5) AS unrate, CAST(count(*) AS DOUBLE) AS cpi, avg(o_totalprice) / 1e5 AS fedfunds FROM orders GROUP BY 1",
    "sector_pair": f"SELECT * FROM (VALUES {_values(SECTOR_PAIRS)}) t(sector, currency_pair, foreign_ratio)",
    "sector_commodity": f"SELECT * FROM (VALUES {_values(SECTOR_COMMODITIES)}) t(sector, commodity, sensitivity)",
    "fx_daily": "SELECT currency_pair, date, avg(price) AS fx_rate FROM trades JOIN universe USING (ticker) JOIN sector_pair USING (sector) GROUP BY ALL",
    "rates": "SELECT currency_pair, min(date) AS date, (arg_min(fx_rate, date) - 1500) / 500 AS interest_diff FROM fx_daily GROUP BY currency_pair, date_trunc('month', date)",
    "commodity_daily": f"SELECT p_type AS commodity, date, {_BAR} FROM trades JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "commodity_gapped": "SELECT * FROM commodity_daily WHERE dayofyear(date) % 11 <> 0",
    "bond_universe": f"SELECT 'B' || p_partkey AS bond_id, 'S' || (p_partkey % 10) AS ticker, ({list(RATINGS)})[p_partkey % 13 + 1] AS credit_rating, p_size / 10.0 AS coupon_rate, 1 + p_size % 30 AS maturity_years, 80 + p_retailprice % 40 AS price, 1000 + p_partkey % 500 AS units_issued, 800 + p_partkey % 200 AS units_outstanding FROM part",
    "loans": "SELECT 'L' || o_orderkey AS loan_id, 'S' || (o_orderkey % 10) AS ticker, CAST(o_orderdate AS DATE) AS issue_date, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(3 + o_orderkey % 36 AS INTEGER)) AS DATE) AS maturity_date, o_totalprice AS notional_usd, (2 + o_orderkey % 7) / 100.0 AS coupon_rate, CAST(100 + o_orderkey % 300 AS DOUBLE) AS spread_bps FROM orders",
    "ticks": "SELECT event_type AS ticker, event_id, ts, value AS open, value * 1.01 AS high, value * 0.99 AS low, value AS close, CAST(CAST(json_extract(props, '$.k') AS INTEGER) AS DOUBLE) AS volume FROM events",
    "dirty0": "SELECT ticker, event_id, ts, open, CASE WHEN event_id % 31 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN event_id % 29 = 0 THEN -close ELSE close END AS close, volume, epoch_us(ts) AS arrival FROM ticks",
    "dirty_ticks": "SELECT * FROM dirty0 UNION ALL SELECT * FROM dirty0 WHERE event_id % 17 = 0 UNION ALL SELECT * REPLACE (arrival + 3600000000 AS arrival) FROM dirty0 WHERE event_id % 23 = 0",
}
