"""Further queries of scans (S), sinks (K), filters (P), joins (J), aggregates (A), ordering (T), sets (U), scalars (F), quality (D) and serving (Q)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators import aggregates as A
from riskspark.operators import filters as P
from riskspark.operators import intraday, loans, quality, sketches, tables
from riskspark.operators import joins as J
from riskspark.plans import fixtures as X
from riskspark.plans import market as M
from riskspark.plans import q_serving as Q
from riskspark.plans import serving as V
from riskspark.plans.query import query
from riskspark.sources import scans


@query("S02_decode_envelopes", "ticker event_id close:4 place", "SELECT ticker, event_id, close, row_number() OVER (PARTITION BY ticker, date_trunc('hour', ts) ORDER BY ts, event_id) - 1 AS place FROM ticks")
def s02(spark, sf):
    t = X.ticks(spark, sf).withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
    bar = F.struct("ts", "event_id", F.struct(F.concat("ticker", F.lit("#"), F.col("event_id").cast("string")).alias("ticker"), "open", "high", "low", "close", "volume", "timestamp").alias("bar"))
    hours = t.groupBy("ticker", F.date_trunc("hour", "ts").alias("hour")).agg(F.array_sort(F.collect_list(bar)).alias("bars"))  # an hour of one key
    sent = hours.select(F.to_json(F.struct(F.lit("b1").alias("batch_id"), F.transform("bars", lambda b: b["bar"]).alias("tickers"))).alias("value"))
    parts = F.split("ticker", "#")
    return scans.decoded(sent).select(parts[0].alias("ticker"), parts[1].cast("long").alias("event_id"), "close", F.col("place").cast("long").alias("place"))


@query("S03_replay_scan", "n no_topic", "SELECT 2 * count(*) AS n, 2 * count(*) AS no_topic FROM events")
def s03(spark, sf):
    return scans.replay(spark, [f"{sf}/events.parquet", f"{sf}/events.parquet"]).agg(F.count("*").alias("n"), F.count_if(F.col("topic").isNull()).alias("no_topic"))


@query("S04_newest_file", "n", "SELECT count(*) AS n FROM nation")
def s04(spark, sf):
    df = spark.read.parquet(f"{sf}/nation.parquet").withColumns({"_file": F.col("_metadata.file_path"), "_time": F.col("_metadata.file_modification_time")})
    newest = df.agg(F.max(F.struct("_time", "_file")).alias("_newest"))
    return df.join(F.broadcast(newest)).where(F.col("_file") == F.col("_newest._file")).agg(F.count("*").alias("n"))


@query("S07_raw_layer", "record_id close:4", "SELECT ticker || '_' || strftime(date, '%Y-%m-%d') AS record_id, close FROM bars_daily")
def s07(spark, sf):
    return A.keep_last(scans.with_record_id(X.bars_daily(spark, sf), "ticker"), ["record_id"], F.desc("close"))


@query("S14_rolling_layer", "ticker date max_date", "SELECT ticker, date, max(date) OVER () AS max_date FROM bars_daily")
def s14(spark, sf):
    df, last = scans.with_max_date(X.bars_daily(spark, sf))
    return df.join(F.broadcast(last))


@query("K03_failed_keys", "commodity date", "SELECT commodity, date FROM (SELECT DISTINCT commodity FROM commodity_daily) CROSS JOIN (SELECT DISTINCT date FROM bars_daily) ANTI JOIN commodity_gapped USING (commodity, date)")
def k03(spark, sf):
    return J.missing(X.commodity_daily(spark, sf).select("commodity").distinct(), X.bars_daily(spark, sf).select("date").distinct(), X.commodity_gapped(spark, sf))


@query("K07_history", "run_mode n", "SELECT 'daily' AS run_mode, count(*) AS n FROM bars_daily")
def k07(spark, sf):
    return tables.with_run_mode(X.bars_daily(spark, sf), "daily").groupBy("run_mode").agg(F.count("*").alias("n"))


@query("K11_clean_write", "mode n", "SELECT 'backfill' AS mode, count(*) AS n FROM bars_daily WHERE date < DATE '1999-12-01' UNION ALL SELECT 'daily', count(*) FROM bars_daily")
def k11(spark, sf):
    old, new = Q._split(spark, sf)
    count = lambda df, mode: df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count(tables.clean_write(old, new.limit(0), "backfill", ["ticker", "date"], "1999-12-01", "1999-12-31"), "backfill").unionByName(count(tables.clean_write(old, new, "daily", ["ticker", "date"]), "daily"))


@query("K13_replaced_from", "ticker date close:4", "SELECT ticker, date, CASE WHEN date >= DATE '1999-12-01' THEN close + 1 ELSE close END AS close FROM bars_daily")
def k13(spark, sf):
    return tables.replaced_from(*Q._split(spark, sf), "1999-12-01")


@query("K15_catalog", "name units", "SELECT bond_id AS name, CAST(coalesce(floor(units_issued + 0.5), 0) AS BIGINT) AS units FROM bond_universe")
def k15(spark, sf):
    return tables.for_catalog(X.bond_universe(spark, sf), {"name": "string", "units": "long"}, {"bond_id": "name", "units_issued": "units"})


@query("P12_source_lineage", "ticker source_run_id", "SELECT ticker, 'r9' AS source_run_id FROM universe")
def p12(spark, sf):
    return P.lineage_to_source(P.with_lineage(X.universe(spark, sf), run_id="r9"), ["run_id", "absent"])


@query("P13_serving_columns", "ticker sector", "SELECT ticker, sector FROM universe")
def p13(spark, sf):
    return P.without(X.universe(spark, sf), ["industry", "revenue"])


@query("P15_allow_list", "ticker revenue:2", "SELECT ticker, revenue FROM universe")
def p15(spark, sf):
    return P.allowed(X.universe(spark, sf), ["ticker", "absent", "revenue"])


@query("P18_rescaled", "o_orderkey o_totalprice:2 o_orderdate", "SELECT o_orderkey, o_totalprice * 1000 AS o_totalprice, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders")
def p18(spark, sf):
    return P.rescaled(X.table(spark, sf, "orders"), "o_totalprice", 1000.0, "o_orderdate")


@query("J10_exposure_chain", "ticker commodity date mtm_value:2", "SELECT ticker, commodity, date, mtm_value FROM universe JOIN sector_commodity USING (sector) LEFT JOIN commodity_daily USING (commodity) JOIN mtm USING (ticker, date)")
def j10(spark, sf):
    exposed = J.to_dimension(X.universe(spark, sf), X.sector_commodity(spark, sf), "sector", "inner")
    traded = F.broadcast(X.commodity_daily(spark, sf).select("commodity", "date"))  # a row for each commodity and day
    return M.market_values(spark, sf).join(exposed, "ticker").join(traded, ["commodity", "date"])  # a day without a commodity's has no date to join values on


_MONTHS = "SELECT ticker, CAST(date_trunc('month', date) AS DATE) AS month, avg(close) AS c, sum(volume) AS v FROM bars_daily GROUP BY 1, 2"


@query("J11_monthly_spine", "ticker month c:4 v:2 gdp:4", f"SELECT ticker, month, c, v, gdp FROM ({_MONTHS}) LEFT JOIN macro USING (month)")
def j11(spark, sf):
    bars = X.bars_daily(spark, sf)
    spine = bars.select("ticker", F.trunc("date", "month").alias("month")).distinct()
    parts = [(loans.monthly(bars, "ticker", {"c": F.avg("close")}), ["ticker", "month"]), (loans.monthly(bars, "ticker", {"v": F.sum("volume")}), ["ticker", "month"]), (X.macro(spark, sf), ["month"])]
    return reduce(lambda df, p: df.join(p[0], p[1], "left"), parts, spine)


@query("J14_spine", "date dgs10:6", "SELECT date, fedfunds AS dgs10 FROM (SELECT DISTINCT date FROM bars_daily) LEFT JOIN macro ON date = month")
def j14(spark, sf):
    return X.bars_daily(spark, sf).select("date").distinct().join(M.yields(spark, sf), "date", "left")


@query("J17_coverage_by_sector", "sector total present", "SELECT sector, count(*) AS total, count(b.ticker) AS present FROM universe u LEFT JOIN (SELECT DISTINCT ticker FROM bars_daily WHERE date = (SELECT max(date) FROM bars_daily)) b USING (ticker) GROUP BY sector")
def j17(spark, sf):
    today = tables.latest_dates(X.bars_daily(spark, sf), 1).select("ticker", F.lit(1).alias("here")).distinct()
    return X.universe(spark, sf).join(today, "ticker", "left").groupBy("sector").agg(F.count("*").alias("total"), F.count("here").alias("present"))


@query("A02_weighted_sum", "asset_manager risk:2", f"SELECT asset_manager, sum(mtm_value * daily_VaR_95) AS risk FROM {Q._EQ} GROUP BY 1")
def a02(spark, sf):
    return Q._eq(spark, sf).groupBy("asset_manager").agg(F.sum(F.col("mtm_value") * F.col("daily_VaR_95")).alias("risk"))


_SOLD = "SELECT coalesce(sector, 'FIRM') AS sector, count(DISTINCT l_partkey) AS parts, true AS parts_within, count(*) AS trades, true AS median_within FROM trades JOIN universe USING (ticker) GROUP BY ROLLUP (sector)"


@query("A04_sketch_rollup", "sector parts parts_within trades median_within", _SOLD)
def a04_sketch(spark, sf):
    """Sketches of tickers, written and rolled up to sectors and the firm, beside exact counts and the exact share of trades at or below the median's bounds."""
    sold = X._trades(spark, sf).join(X.universe(spark, sf).select("ticker", "sector"), "ticker")
    fine = tables.staged(sketches.sketched(sold, ["sector", "ticker"], {"l_partkey": "parts_sketch"}, {"price": "price_sketch"}))
    sectors = sketches.rolled(fine, ["sector"], ["parts_sketch"], ["price_sketch"])
    firm = sketches.rolled(fine, [], ["parts_sketch"], ["price_sketch"]).withColumn("sector", F.lit("FIRM"))
    told = sketches.with_quantile(sketches.with_counts(sectors.unionByName(firm), "parts_sketch", "estimate"), "price_sketch", "median", 0.5)
    told = tables.staged(told.drop("parts_sketch", "price_sketch"))
    rows = sold.select(F.explode(F.array("sector", F.lit("FIRM"))).alias("sector"), "l_partkey", "price").join(told, "sector")
    per = rows.groupBy("sector").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("trades"), F.max("estimate_low").alias("low"), F.max("estimate_high").alias("high"),
        F.avg((F.col("price") <= F.col("median_low")).cast("int")).alias("below"), F.avg((F.col("price") <= F.col("median_high")).cast("int")).alias("above"),
    )
    return per.select("sector", "parts", F.col("parts").between(F.col("low"), F.col("high")).alias("parts_within"), "trades", ((F.col("below") <= 0.5 + 0.01) & (F.col("above") >= 0.5 - 0.01)).alias("median_within"))


@query("A04_count_distinct", "suppliers parts", "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem")
def a04(spark, sf):
    return X.table(spark, sf, "lineitem").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"))


@query("A05_filtered", "l_returnflag large total:2", "SELECT l_returnflag, count(*) FILTER (l_quantity > 40) AS large, sum(CASE WHEN l_discount > 0.05 THEN l_quantity ELSE 0 END) AS total FROM lineitem GROUP BY 1")
def a05(spark, sf):
    return X.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 40).alias("large"), F.sum(F.when(F.col("l_discount") > 0.05, F.col("l_quantity")).otherwise(0.0)).alias("total"))


@query("A06_safe_ratio", "l_returnflag ratio:8", "SELECT l_returnflag, sum(l_tax) / nullif(sum(l_discount), 0) AS ratio FROM lineitem GROUP BY 1")
def a06(spark, sf):
    return X.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.safe_ratio(F.sum("l_tax"), F.sum("l_discount")).alias("ratio"))


@query("A07_expression_bounds", "lowest:4 highest:4", "SELECT min(l_extendedprice * (1 - l_discount)) AS lowest, max(l_extendedprice * (1 - l_discount)) AS highest FROM lineitem")
def a07(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return X.table(spark, sf, "lineitem").agg(F.min(net).alias("lowest"), F.max(net).alias("highest"))


@query("A10_mode", "ticker flag", "SELECT 'S' || l_suppkey AS ticker, min_by(l_returnflag, (-n, l_returnflag)) AS flag FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def a10(spark, sf):
    return X._trades(spark, sf).groupBy("ticker").agg(A.smallest_mode(F.col("l_returnflag")).alias("flag"))


@query("A11_first_three", "ticker flags", "SELECT 'S' || l_suppkey AS ticker, array_to_string(list_slice(list_sort(list_distinct(list(l_returnflag || l_linestatus))), 1, 3), '|') AS flags FROM lineitem GROUP BY 1")
def a11(spark, sf):
    return X._trades(spark, sf).groupBy("ticker").agg(A.first_distinct(F.concat("l_returnflag", "l_linestatus")).alias("flags"))


@query("A17_month_end", "month fx_rate:6", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, arg_max(fx_rate, date) AS fx_rate FROM fx_daily WHERE currency_pair = 'USDJPY' GROUP BY 1")
def a17(spark, sf):
    fx = X.fx_daily(spark, sf).where("currency_pair = 'USDJPY'")
    return A.month_end(fx, "date", "fx_rate", fx.select(F.trunc("date", "month").alias("month")).distinct())


@query("T02_top_rows", "bond_id price:2", "SELECT bond_id, price FROM bond_universe ORDER BY price DESC, bond_id LIMIT 7")
def t02(spark, sf):
    return A.top_groups(X.bond_universe(spark, sf), F.desc("price"), 7, "bond_id")


@query("T03_largest_losses", "ticker date daily_return:6", "SELECT ticker, date, daily_return FROM feat0 WHERE daily_return IS NOT NULL ORDER BY daily_return, ticker, date LIMIT 5")
def t03(spark, sf):
    return A.top_groups(M.equity_features(spark, sf).where("daily_return is not null"), F.asc("daily_return"), 5, "ticker", "date")


@query("T05_full_order", "ticker date close:4", "SELECT ticker, date, close FROM bars_daily ORDER BY date, ticker")
def t05(spark, sf):
    return X.bars_daily(spark, sf).orderBy("date", "ticker")


@query("U01_union_all", "ticker n", "SELECT ticker, 2 * count(*) AS n FROM bars_daily GROUP BY 1")
def u01(spark, sf):
    return tables.union_all([X.bars_daily(spark, sf)] * 2).groupBy("ticker").agg(F.count("*").alias("n"))


@query("U05_unpivot", "month name value:6", "SELECT month, unnest(['unrate', 'fedfunds']) AS name, unnest([unrate, fedfunds]) AS value FROM macro")
def u05(spark, sf):
    return X.macro(spark, sf).unpivot(["month"], ["unrate", "fedfunds"], "name", "value")


@query("U06_distinct", "ticker month", "SELECT DISTINCT ticker, CAST(date_trunc('month', date) AS DATE) AS month FROM bars_daily")
def u06(spark, sf):
    return X.bars_daily(spark, sf).select("ticker", F.trunc("date", "month").alias("month")).distinct()


@query("F03_identifiers", "id", "SELECT concat_ws('_', 'EqFwd', ticker, strftime(date, '%Y-%m-%d'), split_part('First Second', ' ', 1)) AS id FROM bars_daily")
def f03(spark, sf):
    return X.bars_daily(spark, sf).select(S.joined_id(F.lit("EqFwd"), F.col("ticker"), S.day_text(F.col("date")), F.lit(None).cast("string"), S.first_word(F.lit("First Second"))).alias("id"))


@query("F06_weighted_choice", "event_id kind reuse", f"SELECT event_id, {M._ladder(M._hash(chr(39) + 'k' + chr(39) + ' || event_id', 10000) + ' / 10000.0', (('Cash', 0.7), ('Treasury', 0.95), ('CorporateBond', 1.0)))} AS kind, CAST({M._hash(chr(39) + 'r' + chr(39) + ' || event_id', 10000)} < 3500 AS INTEGER) AS reuse FROM events")
def f06(spark, sf):
    key = F.col("event_id").cast("string")
    share = S.stable_hash(F.concat(F.lit("k"), key), 10_000) / 10_000.0
    return X.table(spark, sf, "events").select("event_id", S.ladder(share, (("Cash", 0.7), ("Treasury", 0.95), ("CorporateBond", 1.0))).alias("kind"), (S.stable_hash(F.concat(F.lit("r"), key), 10_000) < 3500).cast("int").alias("reuse"))


@query("F10_clean_numbers", "event_id x:4", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS x FROM events")
def f10(spark, sf):
    dirty = F.when(F.col("event_id") % 10 == 0, float("nan")).when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value"))
    return X.table(spark, sf, "events").select("event_id", W.clean(dirty).alias("x"))


@query("F12_normal_constants", "z05:6 z01:6 d:6", "SELECT -1.6448536269514722 AS z05, -2.3263478740408408 AS z01, exp(-(1.6448536269514722 * 1.6448536269514722) / 2) / sqrt(2 * pi()) AS d FROM region WHERE r_regionkey = 0")
def f12(spark, sf):
    return X.table(spark, sf, "region").where("r_regionkey = 0").select(F.lit(S.Z_05).alias("z05"), F.lit(S.Z_01).alias("z01"), F.lit(S.density(S.Z_05)).alias("d"))


def _steps(c: str):
    """Sum of the absolute steps of an array of any length."""
    steps = F.zip_with(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, F.size(c) - 1), lambda b, a: F.abs(b - a))
    return F.when(F.size(c) > 1, F.aggregate(steps, F.lit(0.0), lambda acc, x: acc + x))


@query("F14_arrays", "ticker steps:4", "SELECT ticker, list_sum(list_transform(range(2, len(c) + 1), lambda i: abs(c[i] - c[i - 1]))) AS steps FROM (SELECT ticker, list(close ORDER BY date) AS c FROM bars_daily WHERE date >= DATE '2001-06-01' GROUP BY ticker)")
def f14(spark, sf):
    rows = X.bars_daily(spark, sf).where("date >= '2001-06-01'").groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("c"))
    return rows.withColumn("steps", _steps("c"))


@query("F14_arrays_all_days", "ticker steps:4", "SELECT ticker, sum(abs(close - before)) AS steps FROM (SELECT ticker, close, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars_daily) GROUP BY ticker")
def f14_all(spark, sf):
    rows = X.bars_daily(spark, sf).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("c"))
    return rows.withColumn("steps", _steps("c"))


@query("D01_enforced_schema", "l_orderkey l_quantity:2", "SELECT l_orderkey, l_quantity FROM lineitem")
def d01(spark, sf):
    text = X.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("l_orderkey"), F.col("l_quantity").cast("string").alias("l_quantity"))
    return quality.enforce_schema(text, {"l_orderkey": "long", "l_quantity": "double"})


_NEWFX, _OLDFX = "fx_rated WHERE date >= DATE '2001-01-01' AND currency_pair < 'USDD'", "(SELECT * REPLACE (fx_rate / 3 AS fx_rate) FROM fx_rated) WHERE date < DATE '2001-01-01'"


@query("D04_fx_drift", "type ratio:4", f"SELECT * FROM (SELECT 'spread_ratio' AS type, (SELECT stddev_samp(fx_rate) FROM {_NEWFX}) / (SELECT stddev_samp(fx_rate) FROM {_OLDFX}) AS ratio) WHERE ratio > 2 UNION ALL SELECT * FROM (SELECT 'level_shift', abs((SELECT avg(interest_diff) FROM {_NEWFX}) - (SELECT avg(interest_diff) FROM {_OLDFX})) / (SELECT stddev_samp(interest_diff) FROM {_OLDFX}) AS ratio) WHERE ratio > 2 UNION ALL SELECT * FROM (SELECT 'coverage_drop', (SELECT count(DISTINCT currency_pair) FROM {_NEWFX}) / (SELECT count(DISTINCT currency_pair) FROM {_OLDFX}) AS ratio) WHERE ratio < 0.8")
def d04(spark, sf):
    fx = M.fx_rated(spark, sf)
    return quality.spread_drift(fx.where("date >= '2001-01-01' and currency_pair < 'USDD'"), fx.where("date < '2001-01-01'").withColumn("fx_rate", F.col("fx_rate") / 3), "currency_pair", "fx_rate", "interest_diff")


@query("ST03_deduplicated", "ticker n", "SELECT ticker, count(DISTINCT ts) AS n FROM dirty_ticks GROUP BY 1")
def st03(spark, sf):
    return X.dirty_ticks(spark, sf).dropDuplicates(["ticker", "ts"]).groupBy("ticker").agg(F.count("*").alias("n"))


@query("ST05_late_policy", "ticker emitted kept", "SELECT ticker, count(*) FILTER (arrival - epoch_us(ts) <= 300000000) AS emitted, count(*) AS kept FROM dirty_ticks GROUP BY 1")
def st05(spark, sf):
    late = F.col("arrival") - F.unix_micros("ts") > 300_000_000
    return X.dirty_ticks(spark, sf).groupBy("ticker").agg(F.count_if(~late).alias("emitted"), F.count("*").alias("kept"))


@query("ST11_counters", "received failed deduped late", "SELECT count(*) AS received, count(*) FILTER (close <= 0 OR high < low) AS failed, count(*) - count(DISTINCT (ticker, ts)) AS deduped, count(*) FILTER (arrival - epoch_us(ts) > 300000000) AS late FROM dirty_ticks")
def st11(spark, sf):
    df = X.dirty_ticks(spark, sf)
    one = df.groupBy("ticker", "ts").agg(F.count("*").alias("_n"))
    counts = df.agg(F.count("*").alias("received"), F.count_if(P.bar_error().isNotNull()).alias("failed"), F.count_if(F.col("arrival") - F.unix_micros("ts") > 300_000_000).alias("late"))
    return counts.join(F.broadcast(one.agg(F.sum(F.col("_n") - 1).alias("deduped"))))


def _snapshot(spark, sf) -> DataFrame:
    snap = intraday.latest_snapshot(intraday.metrics(X.ticks(spark, sf), "ticker", Q._ORDER, minutes=Q._MIN), "ticker")
    return intraday.intraday_exposure(snap, Q._held(spark)).where("asset_manager is not null")


@query("Q19_intraday_manager", "ticker asset_manager exposure:3 pnl:3", f"SELECT ticker, asset_manager, shares * close AS exposure, shares * (close - pc) AS pnl FROM ({Q._SNAP}) JOIN {Q._HOLD} USING (ticker) WHERE asset_manager = 'M1'")
def q19(spark, sf):
    return _snapshot(spark, sf).where("asset_manager = 'M1'").select("ticker", "asset_manager", F.col("intraday_exposure").alias("exposure"), F.col("intraday_pnl").alias("pnl"))


@query("Q20_intraday_ticker", "ticker exposure:3 pnl:3 managers", f"SELECT ticker, sum(shares * close) AS exposure, sum(shares * (close - pc)) AS pnl, count(*) AS managers FROM ({Q._SNAP}) JOIN {Q._HOLD} USING (ticker) GROUP BY 1")
def q20(spark, sf):
    return _snapshot(spark, sf).groupBy("ticker").agg(F.sum("intraday_exposure").alias("exposure"), F.sum("intraday_pnl").alias("pnl"), F.count("*").alias("managers"))


@query("Q22_intraday_fx", "ticker exposure:4 pnl:4", f"SELECT ticker, sum(e) AS exposure, sum(e * CASE WHEN na >= 2 THEN ra END) AS pnl FROM (SELECT m.*, row_number() OVER (PARTITION BY ticker ORDER BY n DESC) AS r FROM ({Q.METRICS.replace('- 119', '- 59')}) m) JOIN (VALUES ('click', 'A', 100.0), ('click', 'B', 50.0)) x(ticker, who, e) USING (ticker) WHERE r = 1 GROUP BY ticker")
def q22(spark, sf):
    last = intraday.latest_snapshot(intraday.fx_metrics(X.ticks(spark, sf), "ticker", Q._ORDER, minutes=Q._MIN), "ticker")
    held = spark.createDataFrame([("click", "A", 100.0), ("click", "B", 50.0)], "ticker string, who string, e double")
    return last.join(held, "ticker").groupBy("ticker").agg(F.sum("e").alias("exposure"), F.sum(F.col("e") * F.col("fx_return_1m")).alias("pnl"))


@query("Q10_fx_ticker", "ticker pairs exposure:1 best:1 worst:1", f"SELECT ticker, count(DISTINCT currency_pair) AS pairs, sum(exposure_amount) AS exposure, max(total_pnl) AS best, min(total_pnl) AS worst FROM {Q._FX} GROUP BY 1")
def q10b(spark, sf):
    return M.fx_since(spark, sf, 1).groupBy("ticker").agg(F.count_distinct("currency_pair").alias("pairs"), F.sum("exposure_amount").alias("exposure"), F.max("total_pnl").alias("best"), F.min("total_pnl").alias("worst"))
