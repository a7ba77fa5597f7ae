"""Queries of filters (P), joins (J), aggregates (A), ordering (T), sets (U) and scalars (F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.operators import aggregates as A
from riskspark.operators import filters as P
from riskspark.operators import joins as J
from riskspark.operators import tables
from riskspark.plans import fixtures as X
from riskspark.plans import market as M
from riskspark.plans.query import query
from riskspark.sources import scans


@query("P01_valid_ticks", "ticker event_id volume:1", "SELECT * FROM ticks WHERE volume > 0")
def p01(spark, sf):
    return P.valid_ticks(X.ticks(spark, sf))


@query("P02_bar_validation", "event_id arrival error", "SELECT event_id, arrival, CASE WHEN close <= 0 THEN 'close is not positive' WHEN high < low THEN 'high is below low' END AS error FROM dirty_ticks")
def p02(spark, sf):
    return X.dirty_ticks(spark, sf).withColumn("error", P.bar_error())


@query("P03_equity_session", "event_id", "SELECT event_id FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS t FROM ticks) WHERE hour(t) * 60 + minute(t) >= 570 AND hour(t) < 16 AND dayofweek(t) BETWEEN 1 AND 5")
def p03(spark, sf):
    return X.ticks(spark, sf).where(P.equity_session(F.col("ts")))


@query("P04_fx_session", "event_id", "SELECT event_id FROM (SELECT *, timezone('America/New_York', timezone('UTC', ts)) AS t FROM ticks) WHERE dayofweek(t) BETWEEN 1 AND 4 OR (dayofweek(t) = 0 AND hour(t) >= 17) OR (dayofweek(t) = 5 AND hour(t) < 17)")
def p04(spark, sf):
    return X.ticks(spark, sf).where(P.fx_session(F.col("ts")))


@query("P06_completed_bars", "ticker date close:6", "SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars_daily) WHERE r = 2")
def p06(spark, sf):
    return P.completed_bars(X.bars_daily(spark, sf), "ticker", "date")


_DAYS = "SELECT CAST(d AS DATE) AS date FROM generate_series(DATE '1998-01-01', DATE '1998-12-31', INTERVAL 1 DAY) t(d) WHERE dayofweek(d) BETWEEN 1 AND 5 AND d NOT IN (DATE '1998-01-01', DATE '1998-12-25')"


def _days(spark):
    return P.trading_days(spark, "1998-01-01", "1998-12-31", ["1998-01-01", "1998-12-25"])


@query("P07_trading_days_only", "ticker date close:6", f"SELECT * FROM bars_daily WHERE date IN ({_DAYS})")
def p07(spark, sf):
    return P.on_days(X.bars_daily(spark, sf), _days(spark))


@query("P07_trading_days_all_years", "ticker date close:6", "SELECT * FROM bars_daily WHERE dayofweek(date) BETWEEN 1 AND 5 AND strftime(date, '%m-%d') NOT IN ('01-01', '12-25')")
def p07_all(spark, sf):
    bars = X.bars_daily(spark, sf)
    days = bars.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(F.explode(F.sequence("a", "b")).alias("date"))
    return P.on_days(bars, days.where(F.dayofweek("date").between(2, 6) & ~F.date_format("date", "MM-dd").isin("01-01", "12-25")))


@query("P08_calendar", "month days", "SELECT CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS days FROM (" + _DAYS + ") WHERE date <= (SELECT max(date) FROM bars_daily) GROUP BY 1")
def p08(spark, sf):
    last = X.bars_daily(spark, sf).agg(F.max("date").alias("_last"))
    return _days(spark).join(F.broadcast(last)).where("date <= _last").groupBy(F.trunc("date", "month").alias("month")).agg(F.count("*").alias("days"))


_HARD = "close IS NULL OR close <= 0"


@query("P09_hard_filter", "rows_in null_key bad_price thin rows_out", f"SELECT count(*) AS rows_in, 0 AS null_key, count(*) FILTER ({_HARD}) AS bad_price, count(*) FILTER (NOT ({_HARD}) AND volume < 5) AS thin, count(*) FILTER (NOT ({_HARD}) AND volume >= 5) AS rows_out FROM dirty_ticks")
def p09(spark, sf):
    kept, counts = P.hard_filter(X.dirty_ticks(spark, sf), ["ticker"], "close", "volume", 5)
    return counts.join(F.broadcast(kept.agg(F.count("*").alias("rows_out"))))


@query("P10_run_window", "mode n", "SELECT 'incremental' AS mode, count(*) AS n FROM bars_daily WHERE date > DATE '2000-01-31' UNION ALL SELECT 'backfill', count(*) FROM bars_daily WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-03-31'")
def p10(spark, sf):
    bars = X.bars_daily(spark, sf)
    count = lambda df, mode: df.agg(F.lit(mode).alias("mode"), F.count("*").alias("n"))
    return count(P.run_window(bars, "incremental", "2000-01-31"), "incremental").unionByName(count(P.run_window(bars, "backfill", start="1999-01-01", end="1999-03-31"), "backfill"))


@query("P11_lineage", "ticker source_run source_version", "SELECT ticker, 'r1' AS source_run, 2 AS source_version FROM universe")
def p11(spark, sf):
    return P.without(P.lineage_to_source(P.with_lineage(X.universe(spark, sf), run="r1", version=2), ["run", "version"]), ["sector"])


@query("P14_ensured_columns", "ticker extra", "SELECT ticker, CAST(NULL AS DOUBLE) AS extra FROM universe")
def p14(spark, sf):
    return P.allowed(P.ensured(X.universe(spark, sf), {"extra": "double", "ticker": "string"}), ["ticker", "absent", "extra"])


@query("P16_contract_keys", "sector too_long", "SELECT DISTINCT upper(trim(sector)) AS sector, length(upper(trim(sector))) > 7 AS too_long FROM universe")
def p16(spark, sf):
    return P.contract_keys(X.universe(spark, sf).withColumn("sector", F.concat(F.lit(" "), F.lower("sector"))), "sector", 7)


@query("P17_for_export", "ticker total_debt:2 day", "SELECT ticker, coalesce(total_debt, 0) AS total_debt, '2020-01-31' AS day FROM fundamentals")
def p17(spark, sf):
    return P.for_export(P.rescaled(X.fundamentals(spark, sf).withColumn("day", F.lit("2020-01-31")), "total_debt", 1.0, "day"))


@query("J01_ticks_positions", "ticker date asset_manager shares:2", "SELECT b.ticker, b.date, asset_manager, shares FROM bars_daily b LEFT JOIN positions p USING (ticker)")
def j01(spark, sf):
    return J.to_dimension(X.bars_daily(spark, sf), X.positions(spark, sf), "ticker")


@query("J02_fan_out", "currency_pair date ticker fx_rate:6", "SELECT currency_pair, date, ticker, fx_rate FROM fx_daily JOIN fx_exposed USING (currency_pair)")
def j02(spark, sf):
    return J.fan_out(X.fx_daily(spark, sf), M.fx_exposed(spark, sf), "currency_pair")


@query("J03_features_fundamentals", "ticker date daily_return:6 total_assets:2", "SELECT * FROM feat JOIN fundamentals USING (ticker)")
def j03(spark, sf):
    return M.equity_features(spark, sf).join(X.fundamentals(spark, sf), "ticker")


@query("J04_month_join", "ticker date gdp:4", "SELECT ticker, date, gdp FROM bars_daily LEFT JOIN macro ON date_trunc('month', date) = month")
def j04(spark, sf):
    return J.month_join(X.bars_daily(spark, sf), X.macro(spark, sf), "left")


@query("J05_as_of", "currency_pair date fx_rate:6 interest_diff:6", "SELECT * FROM fx_rated")
def j05(spark, sf):
    return M.fx_rated(spark, sf)


_PAIRS = [p[1] for p in X.SECTOR_PAIRS]


@query("J06_outer_chain", "date " + " ".join(f"{p}:6" for p in _PAIRS), "SELECT date, " + ", ".join(f"max(fx_rate) FILTER (currency_pair = '{p}') AS {p}" for p in _PAIRS) + " FROM fx_daily GROUP BY date")
def j06(spark, sf):
    fx = X.fx_daily(spark, sf)
    return J.outer_chain({p: fx.where(F.col("currency_pair") == p) for p in _PAIRS}, value="fx_rate")


@query("J07_active_months", "loan_id month", "SELECT * FROM (SELECT loan_id, issue_date, CAST(unnest(generate_series(CAST(date_trunc('month', issue_date) AS DATE), maturity_date, INTERVAL 1 MONTH)) AS DATE) AS month FROM loans) WHERE month >= issue_date")
def j07(spark, sf):
    return J.active_months(X.loans(spark, sf), "issue_date", "maturity_date")


@query("J08_missing_keys", "commodity date", "SELECT commodity, date FROM (SELECT DISTINCT commodity FROM commodity_gapped) CROSS JOIN (SELECT DISTINCT date FROM commodity_daily) ANTI JOIN commodity_gapped USING (commodity, date)")
def j08(spark, sf):
    gapped = X.commodity_gapped(spark, sf)
    return J.missing(gapped.select("commodity").distinct(), X.commodity_daily(spark, sf).select("date").distinct(), gapped)


@query("J09_every_day", "bond_id date", "SELECT bond_id, date FROM bond_universe CROSS JOIN bond_days")
def j09(spark, sf):
    return J.every_day(X.bond_universe(spark, sf), M.bond_days(spark, sf))


@query("J12_mapped", "commodity scale:2", "SELECT DISTINCT commodity, coalesce(CASE commodity WHEN 'PROMO' THEN 0.6 WHEN 'LARGE' THEN 0.5 END, 0.7) AS scale FROM commodity_daily")
def j12(spark, sf):
    scales = spark.createDataFrame([("PROMO", 0.6), ("LARGE", 0.5)], "commodity string, scale double")
    return J.mapped(X.commodity_daily(spark, sf).select("commodity").distinct(), scales, "commodity", "scale", 0.7)


@query("J13_expanded", "ticker commodity weight:2", "SELECT ticker, c AS commodity, w AS weight FROM universe, (VALUES ('GOLD', 0.5), ('OIL', 0.25)) t(c, w) WHERE sector = 'ASIA'")
def j13(spark, sf):
    weights = F.when(F.col("sector") == "ASIA", F.create_map(F.lit("GOLD"), F.lit(0.5), F.lit("OIL"), F.lit(0.25)))
    return J.expanded(X.universe(spark, sf), weights, "commodity", "weight")


@query("J15_filled_key", "ticker date record_id", "SELECT ticker, date, ticker || '_' || strftime(date, '%Y-%m-%d') AS record_id FROM bars_daily")
def j15(spark, sf):
    bars = X.ticker_days(spark, sf, "ticker", "date")  # dealt by the keys of the join
    lookup = scans.with_record_id(bars, "ticker")
    return J.filled_key(bars.withColumn("record_id", F.lit(None).cast("string")), lookup, ["ticker", "date"], "record_id")


@query("J16_semi_anti", "ticker side", "SELECT ticker, CASE WHEN ticker IN (SELECT ticker FROM bond_universe) THEN 'in' ELSE 'out' END AS side FROM universe")
def j16(spark, sf):
    u, keys = X.universe(spark, sf), X.bond_universe(spark, sf).select("ticker").distinct()
    return u.join(keys, "ticker", "left_semi").withColumn("side", F.lit("in")).unionByName(u.join(keys, "ticker", "left_anti").withColumn("side", F.lit("out")))


@query("A01_summary", "total:2 mean:6 n", "SELECT sum(volume) AS total, avg(close) AS mean, count(*) AS n FROM bars_daily")
def a01(spark, sf):
    return X.bars_daily(spark, sf).agg(F.sum("volume").alias("total"), F.avg("close").alias("mean"), F.count("*").alias("n"))


@query("A03_grouped", "sector total:2 worst:6 best:6 tickers positive ratio:6", "SELECT sector, sum(shares * revenue) / 1e6 AS total, min(shares - 100) AS worst, max(shares - 100) AS best, count(DISTINCT ticker) AS tickers, count(*) FILTER (shares > 150) AS positive, sum(shares) / nullif(sum(revenue), 0) AS ratio FROM positions JOIN universe USING (ticker) GROUP BY sector")
def a03(spark, sf):
    df = X.positions(spark, sf).join(X.universe(spark, sf), "ticker")
    return df.groupBy("sector").agg((F.sum(F.col("shares") * F.col("revenue")) / 1e6).alias("total"), F.min(F.col("shares") - 100).alias("worst"), F.max(F.col("shares") - 100).alias("best"), F.count_distinct("ticker").alias("tickers"), F.count_if(F.col("shares") > 150).alias("positive"), A.safe_ratio(F.sum("shares"), F.sum("revenue")).alias("ratio"))


@query("A08_share_of_total", "asset_manager share:8", "SELECT asset_manager, sum(shares) / (SELECT sum(shares) FROM positions) AS share FROM positions GROUP BY asset_manager")
def a08(spark, sf):
    return A.with_total(X.positions(spark, sf).groupBy("asset_manager").agg(F.sum("shares").alias("shares")), "shares")


@query("A09_monthly_rollup", "ticker month mean:6 modal first3 any_big", "SELECT ticker, month, avg(mean) AS mean, any_value(modal) AS modal, any_value(first3) AS first3, max(any_big) AS any_big FROM (SELECT 'S' || l_suppkey AS ticker, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS mean, (SELECT 1) AS one, max(CASE WHEN l_quantity > 49 THEN 1 ELSE 0 END) AS any_big, array_to_string(list_slice(list_sort(list_distinct(list(l_returnflag || l_linestatus))), 1, 3), '|') AS first3, min_by(f, (-n, f)) AS modal FROM (SELECT *, l_returnflag AS f, count(*) OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate), l_returnflag) AS n FROM lineitem) GROUP BY 1, 2) GROUP BY 1, 2")
def a09(spark, sf):
    df = X.table(spark, sf, "lineitem")
    return df.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.trunc("l_shipdate", "month").alias("month")).agg(
        F.avg("l_quantity").alias("mean"), A.smallest_mode(F.col("l_returnflag")).alias("modal"), A.first_distinct(F.concat("l_returnflag", "l_linestatus")).alias("first3"), F.max((F.col("l_quantity") > 49).cast("int")).alias("any_big")
    )


@query("A12_keep_last", "ticker date close:6", "SELECT ticker, date, close FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS r FROM bars_daily) WHERE r = 1")
def a12(spark, sf):
    return A.keep_last(X.bars_daily(spark, sf), ["ticker"], F.desc("date"))


@query("A14_standard_score", "ticker z:6", "SELECT ticker, (revenue - avg(revenue) OVER ()) / stddev_samp(revenue) OVER () AS z FROM universe")
def a14(spark, sf):
    return A.standard_score(X.universe(spark, sf), "revenue", "z")


@query("A15_median", "asset_manager median:4", "SELECT asset_manager, quantile_cont(shares, 0.5) AS median FROM positions GROUP BY 1")
def a15(spark, sf):
    return X.positions(spark, sf).groupBy("asset_manager").agg(F.percentile("shares", 0.5).alias("median"))


@query("A16_manager_tickers", "asset_manager n", "SELECT asset_manager, count(DISTINCT ticker) AS n FROM positions GROUP BY 1")
def a16(spark, sf):
    return X.positions(spark, sf).groupBy("asset_manager").agg(F.count_distinct("ticker").alias("n"))


@query("T01_top_groups", "ticker total:2", "SELECT ticker, sum(shares) AS total FROM positions GROUP BY 1 ORDER BY total DESC, ticker LIMIT 10")
def t01(spark, sf):
    return A.top_groups(X.positions(spark, sf).groupBy("ticker").agg(F.sum("shares").alias("total")), F.desc("total"), 10, "ticker")


@query("T04_top_movers", "ticker date daily_return:6", "SELECT ticker, date, daily_return FROM feat0 WHERE daily_return IS NOT NULL ORDER BY abs(daily_return) DESC, ticker, date LIMIT 10")
def t04(spark, sf):
    return A.top_groups(M.equity_features(spark, sf).where("daily_return is not null"), F.abs("daily_return").desc(), 10, "ticker", "date")


@query("U02_union_missing", "key extra:2", "SELECT ticker AS key, revenue AS extra FROM universe UNION ALL SELECT commodity, NULL FROM commodity_daily")
def u02(spark, sf):
    return tables.union_all([X.universe(spark, sf).select(F.col("ticker").alias("key"), F.col("revenue").alias("extra")), X.commodity_daily(spark, sf).select(F.col("commodity").alias("key"))], missing=True)


@query("U03_trades_union", "date asset_class ticker underlying_price:4 notional:2", "SELECT * FROM tr")
def u03(spark, sf):
    return M.trade_frames(spark, sf)


@query("U04_set_difference", "date side", "SELECT date, 'gap' AS side FROM (SELECT date FROM commodity_daily EXCEPT SELECT date FROM commodity_gapped) UNION ALL SELECT date, 'both' FROM (SELECT date FROM commodity_daily INTERSECT SELECT date FROM commodity_gapped)")
def u04(spark, sf):
    a, b = X.commodity_daily(spark, sf).select("date"), X.commodity_gapped(spark, sf).select("date")
    return a.distinct().exceptAll(b.distinct()).withColumn("side", F.lit("gap")).unionByName(a.intersect(b).withColumn("side", F.lit("both")))


@query("F01_names", "name lower_name", "SELECT replace(p_name, ' ', '-') AS name, lower(p_name) AS lower_name FROM part")
def f01(spark, sf):
    df = X.table(spark, sf, "part").select(F.regexp_replace("p_name", " ", "-").alias("name"))
    return df.withColumn("lower_name", F.lower(S.spaced(F.col("name"))))


@query("F02_symbols", "commodity symbol", "SELECT DISTINCT commodity || '=F' AS commodity, commodity AS symbol FROM commodity_daily")
def f02(spark, sf):
    df = X.commodity_daily(spark, sf).select(F.concat("commodity", F.lit("=F")).alias("commodity")).distinct()
    return df.withColumn("symbol", S.symbol(F.col("commodity")))


@query("F04_hashes", "event_id sha md", "SELECT event_id, sha256(event_type || event_id) AS sha, md5(event_type || event_id) AS md FROM events")
def f04(spark, sf):
    key = F.concat("event_type", F.col("event_id").cast("string"))
    return X.table(spark, sf, "events").select("event_id", F.sha2(key, 256).alias("sha"), F.md5(key.cast("binary")).alias("md"))


@query("F05_stable_hash", "event_id h kind", f"SELECT event_id, CAST({M._hash('event_type || event_id', 10000)} AS BIGINT) AS h, CASE WHEN {M._hash('event_type || event_id', 10000)} < 3500 THEN 'a' ELSE 'b' END AS kind FROM events")
def f05(spark, sf):
    h = S.stable_hash(F.concat("event_type", F.col("event_id").cast("string")), 10_000)
    return X.table(spark, sf, "events").select("event_id", h.alias("h"), S.ladder(h, (("a", 3500), ("b", 10_000))).alias("kind"))


@query("F07_dates", "event_id m hour month key", "SELECT event_id, epoch_us(ts) // 60000000 AS m, hour(timezone('America/New_York', timezone('UTC', ts))) AS hour, CAST(date_trunc('month', ts) AS DATE) AS month, strftime(ts, '%m-%y') AS key FROM events")
def f07(spark, sf):
    return X.table(spark, sf, "events").select("event_id", S.minute(F.col("ts")).alias("m"), F.hour(S.eastern(F.col("ts"))).cast("long").alias("hour"), F.trunc("ts", "month").alias("month"), S.month_key(F.col("ts")).alias("key"))


@query("F08_tenors", "loan_id due age:6", "SELECT loan_id, CAST(issue_date + CAST(round_even(spread_bps / 100 * 365, 0) AS INTEGER) AS DATE) AS due, greatest(0, (maturity_date - issue_date) / 30.0) AS age FROM loans")
def f08(spark, sf):
    df = X.loans(spark, sf)
    return df.select("loan_id", S.years_later(F.col("issue_date"), F.col("spread_bps") / 100).alias("due"), S.months_between(F.col("maturity_date"), F.col("issue_date")).alias("age"))


@query("F09_math", "event_id s:8 c:4 l:8", "SELECT event_id, 1 / (1 + exp(-value / 100)) AS s, least(greatest(value, 10), 50) AS c, ln(1 + abs(value)) AS l FROM events")
def f09(spark, sf):
    v = F.col("value")
    return X.table(spark, sf, "events").select("event_id", S.sigmoid(v / 100).alias("s"), S.clip(v, 10, 50).alias("c"), F.log1p(F.abs(v)).alias("l"))


@query("F13_json", "event_id k again", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS again FROM events")
def f13(spark, sf):
    df = X.table(spark, sf, "events").withColumn("p", F.from_json("props", "k long"))
    return df.select("event_id", "p.k", F.to_json("p").alias("again"))


@query("S06_date_range_scan", "ticker n", "SELECT ticker, count(*) AS n FROM trades WHERE l_shipdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-06-30' GROUP BY 1")
def s06(spark, sf):
    df = scans.between(X.table(spark, sf, "lineitem"), F.to_timestamp(F.lit("1998-01-01")), F.to_timestamp(F.lit("1998-06-30")), "l_shipdate")
    return df.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker")).agg(F.count("*").alias("n"))


@query("S09_watermark_scan", "n", "SELECT count(*) AS n FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01'")
def s09(spark, sf):
    return scans.after(X.table(spark, sf, "orders"), F.to_timestamp(F.lit("1998-01-01")), "o_orderdate").agg(F.count("*").alias("n"))


@query("S10_from_month", "n", "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1998-03-01'")
def s10(spark, sf):
    return scans.from_month(X.table(spark, sf, "orders"), "1998-03-17", "o_orderdate").agg(F.count("*").alias("n"))


@query("S11_watermark", "watermark", "SELECT coalesce(CAST(max(o_orderdate) AS DATE), DATE '1990-01-01') AS watermark FROM orders")
def s11(spark, sf):
    return scans.watermark(X.table(spark, sf, "orders"), "1990-01-01", "o_orderdate")


@query("S12_months_present", "month", "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS month FROM orders")
def s12(spark, sf):
    return scans.months_present(X.table(spark, sf, "orders"), "o_orderdate")


@query("S13_static_universe", "sector industry", "SELECT DISTINCT sector, industry FROM universe")
def s13(spark, sf):
    return scans.static_universe(X.universe(spark, sf), ["ticker", "revenue"], ["sector", "industry"])


_RUNS = "SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 'r1' ELSE 'r2' END AS run_id FROM trades"


@query("S05_newest_runs", "date n", f"SELECT date, count(*) AS n FROM ({_RUNS}) t WHERE run_id = (SELECT max(run_id) FROM ({_RUNS}) u WHERE u.date = t.date) GROUP BY date")
def s05(spark, sf):
    df = X._trades(spark, sf).withColumn("run_id", F.when(F.col("l_linenumber") % 3 == 0, "r1").otherwise("r2"))
    return scans.newest_runs(df).groupBy("date").agg(F.count("*").alias("n"))
