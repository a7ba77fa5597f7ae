"""Queries of the views for all keys (Q05 to Q22): no manager, name, pair, month or class is picked beforehand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import windows as W
from riskspark.operators import fx, intraday, stress, tables, trades
from riskspark.plans import fixtures as X
from riskspark.plans import market as M
from riskspark.plans import q_market, views
from riskspark.plans import q_serving as S
from riskspark.plans import serving as V
from riskspark.plans.query import query
from riskspark.plans.staged import Staged

_EQ, _FX, _BD, _CASES = S._EQ, S._FX, S._BD, S._CASES
_MONEY = ", ".join(f"sum(mtm_value * {c}) AS {c}" for c in views.RISKS)
_CM = "cm WHERE date = (SELECT max(date) FROM cm)"
#: The last month with observed loans; the panel runs on to the last maturity.
_OBSERVED = "(SELECT CAST(date_trunc('month', max(issue_date)) AS DATE) FROM loans)"
_LN = f"SELECT * FROM ({q_market.LOANS_SQL}) WHERE month = {_OBSERVED}"


def _eq(spark, sf) -> DataFrame:
    return M.equity_day(spark, sf)


def _top(sql: str, key: str, k: int, order: str) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS place FROM ({sql})) WHERE place <= {k}"


_TOTALS = f"SELECT asset_manager, sum(mtm_value) AS exposure, sum(daily_pnl) AS pnl, {_MONEY}, count(*) FILTER (portfolio_weight > 0.05) AS alerts, count(DISTINCT ticker) AS tickers, sum(mtm_value) / (SELECT sum(mtm_value) FROM {_EQ}) AS portfolio_weight FROM {_EQ} GROUP BY 1"


@query("Q05_manager_totals", "asset_manager scenario exposure:1 daily_pnl:1 portfolio_weight:7 var_95:1 cvar_99:1 alerts tickers", f"SELECT *, pnl + exposure * rs AS daily_pnl, daily_VaR_95 * rm AS var_95, daily_CVaR_99 * rm AS cvar_99 FROM ({_TOTALS}), {_CASES}")
def q05_totals(spark, sf):
    return views.manager_totals(_eq(spark, sf), stress.scenarios(spark)).withColumnsRenamed({"daily_VaR_95": "var_95", "daily_CVaR_99": "cvar_99"})


@query("Q05_all_holdings", "asset_manager ticker sector exposure:1 weight:6 daily_pnl:1 var_pct:6 turnover_ratio:4", _top(f"SELECT asset_manager, ticker, sector, sum(mtm_value) AS exposure, sum(portfolio_weight) AS weight, sum(daily_pnl) AS daily_pnl, coalesce(sum(mtm_value * daily_VaR_95) / nullif(sum(mtm_value), 0), 0) AS var_pct, avg(turnover_ratio) AS turnover_ratio FROM {_EQ} GROUP BY 1, 2, 3", "asset_manager", 20, "exposure DESC, ticker"))
def q05_holdings(spark, sf):
    return views.holdings(_eq(spark, sf))


@query("Q05_contributors", "asset_manager ticker exposure:1 var_usd:1", _top(f"SELECT asset_manager, ticker, sum(mtm_value) AS exposure, sum(mtm_value * daily_VaR_95) AS var_usd FROM {_EQ} AND daily_VaR_95 IS NOT NULL GROUP BY 1, 2", "asset_manager", 5, "var_usd DESC, ticker"))
def q05_contributors(spark, sf):
    return views.contributors(_eq(spark, sf)).withColumnRenamed("daily_VaR_95", "var_usd")


@query("Q05_concentrations", "asset_manager ticker exposure:1 alert severity", _top(f"SELECT asset_manager, ticker, sum(mtm_value) AS exposure, 'Concentration limit breach' AS alert, 'High' AS severity FROM {_EQ} AND portfolio_weight > 0.05 GROUP BY 1, 2", "asset_manager", 10, "exposure DESC, ticker"))
def q05_concentrations(spark, sf):
    return views.concentrations(_eq(spark, sf))


_PREV = ", ".join(f"lag({c}) OVER w AS prev_{c}" for c in ("date", "open", "high", "low", "close", "volume"))


@query("Q06_ticker_market", "ticker date open:4 high:4 low:4 close:4 volume:2 prev_date prev_open:4 prev_close:4 prev_volume:2 daily_return:6 log_return:6 high_low_spread:6 close_open_diff:6", f"SELECT *, close / prev_close - 1 AS daily_return, ln(close / prev_close) AS log_return, (high - low) / open AS high_low_spread, (close - open) / open AS close_open_diff FROM (SELECT *, {_PREV}, lead(date) OVER w AS nd FROM bars_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE nd IS NULL")
def q06_market(spark, sf):
    return views.ticker_market(X.bars_daily(spark, sf))


@query("Q06_ticker_risk", "ticker scenario beta:4 daily_sigma:6 daily_mu:6 var_95:1 cvar_95:1", f"SELECT *, mu + rs AS daily_mu, daily_VaR_95 * rm AS var_95, daily_CVaR_95 * rm AS cvar_95 FROM (SELECT ticker, max(beta) AS beta, max(daily_sigma) AS daily_sigma, max(daily_mu) AS mu, {_MONEY} FROM {_EQ} GROUP BY 1), {_CASES}")
def q06_risk(spark, sf):
    return views.ticker_risk(_eq(spark, sf), stress.scenarios(spark)).withColumnsRenamed({"daily_VaR_95": "var_95", "daily_CVaR_95": "cvar_95"})


_VOLS = ["vol_5d", "vol_20d", "volatility_21d", "ma_5", "momentum_20d", "downside_risk", "sharpe_ratio", "sortino_ratio"]


@query("Q06_ticker_volatility", "ticker scenario " + " ".join(f"{c}:5" for c in _VOLS), f"SELECT ticker, scenario, vol_5d * vm AS vol_5d, vol_20d * vm AS vol_20d, volatility_21d * vm AS volatility_21d, {', '.join(_VOLS[3:])} FROM (SELECT DISTINCT ticker, {', '.join(_VOLS)} FROM {_EQ}), {_CASES}")
def q06_volatility(spark, sf):
    return views.of_names(_eq(spark, sf), _VOLS, stress.scenarios(spark), _VOLS[:3])


@query("Q06_ticker_liquidity", "ticker asset_manager scenario amihud_illiquidity:9 turnover_ratio:6 liquidity_risk_score:6", f"SELECT ticker, asset_manager, scenario, amihud_illiquidity, turnover_ratio, liquidity_risk_score * vm AS liquidity_risk_score FROM {_EQ.replace('eq WHERE', 'eq, ' + _CASES + ' WHERE')}")
def q06_liquidity(spark, sf):
    df = _eq(spark, sf).select("ticker", "asset_manager", "amihud_illiquidity", "turnover_ratio", "liquidity_risk_score")
    return stress.stressed(df, stress.scenarios(spark), "turnover_ratio", volatility=["liquidity_risk_score"])


_BOOKS = ["market_cap", "total_assets", "total_debt", "ebitda", "net_income", "altman_z", "free_cash_flow", "cash_and_equivalents", "interest_coverage_proxy"]


@query("Q06_ticker_fundamentals", "ticker sector industry credit_rating " + " ".join(f"{c}:3" for c in _BOOKS), f"SELECT DISTINCT ticker, sector, industry, credit_rating, {', '.join(_BOOKS)} FROM {_EQ}")
def q06_fundamentals(spark, sf):
    return views.of_names(_eq(spark, sf), ["sector", "industry", "credit_rating", *_BOOKS])


@query("Q08_position_summary", "ticker asset_manager scenario exposure:1 shares:1 daily_pnl:1 portfolio_weight:7 price:4", f"SELECT *, pnl + exposure * rs AS daily_pnl FROM (SELECT ticker, asset_manager, sum(mtm_value) AS exposure, sum(shares) AS shares, sum(daily_pnl) AS pnl, max(portfolio_weight) AS portfolio_weight, max(close) AS price FROM {_EQ} GROUP BY 1, 2), {_CASES}")
def q08_summary(spark, sf):
    return views.position_summary(_eq(spark, sf), stress.scenarios(spark))


#: Stand-ins for the columns of a scored table.
_PREDICTED = {
    "pred_ret_1d": "0.5 * daily_mu", "pred_ret_5d": "0.2 * momentum_5d", "pred_ret_21d": "0.1 * momentum_20d", "pred_vol_21d": "1.1 * volatility_21d", "pred_var_21d": "0.5 * mtm_value * daily_VaR_95", "pred_factor_21d": "0.1 * momentum_5d",
    "pred_sector_rotation": "0.1 * sector_exposure - 0.03", "pred_macro_regime": "CASE WHEN daily_mu < -0.2 THEN 0 ELSE 1 END",
}
_SCORED = f"(SELECT *, {', '.join(f'{e} AS {c}' for c, e in _PREDICTED.items())} FROM {_EQ})"


def _scored(spark, sf) -> DataFrame:
    return _eq(spark, sf).withColumns({c: F.expr(e) for c, e in _PREDICTED.items()})


@query("Q08_position_intelligence", "ticker asset_manager pred_ret_1d:6 pred_vol_21d:6 expected_pnl_1d:1 expected_pnl_5d:1 expected_pnl_21d:1 var_contribution_pct:6", f"SELECT *, exposure * coalesce(pred_ret_1d, 0) AS expected_pnl_1d, exposure * coalesce(pred_ret_5d, 0) AS expected_pnl_5d, exposure * coalesce(pred_ret_21d, 0) AS expected_pnl_21d, pred_var_21d / exposure AS var_contribution_pct FROM (SELECT ticker, asset_manager, {', '.join(f'max({c}) AS {c}' for c in _PREDICTED)}, max(mtm_value) AS exposure FROM {_SCORED} GROUP BY 1, 2) WHERE coalesce(exposure, 0) <> 0")
def q08_intelligence(spark, sf):
    return views.position_intelligence(_scored(spark, sf))


_KINDS = (("Concentration", "High", "portfolio_weight > 0.05"), ("Risk", "High", "coalesce(pred_var_21d, 0) * rm > 0.10 * coalesce(exposure, 0)"), ("Model", "Medium", "pred_factor_21d < -0.05"), ("Sector", "Medium", "pred_sector_rotation < -0.02"), ("Macro", "Medium", "pred_macro_regime = 0"))
_POSITION = f"(SELECT ticker, asset_manager, max(mtm_value) AS exposure, max(portfolio_weight) AS portfolio_weight, {', '.join(f'max({c}) AS {c}' for c in _PREDICTED)} FROM {_SCORED} GROUP BY 1, 2), {_CASES}"


@query("Q08_prediction_alerts", "scenario ticker asset_manager type severity", " UNION ALL ".join(f"SELECT scenario, ticker, asset_manager, '{n}' AS type, '{g}' AS severity FROM {_POSITION} WHERE {c}" for n, g, c in _KINDS))
def q08_alerts(spark, sf):
    return views.prediction_alerts(_scored(spark, sf), stress.scenarios(spark))


def _fx_day(spark, sf) -> DataFrame:
    return M.fx_since(spark, sf, 1)


@query("Q10_all_currencies", "currency_pair ticker exposure:1 pnl:1 worst_var:1", _top(f"SELECT currency_pair, ticker, sum(exposure_amount) AS exposure, sum(total_pnl) AS pnl, max(value_at_risk) AS worst_var FROM {_FX} GROUP BY 1, 2", "currency_pair", 20, "exposure DESC, ticker"))
def q10_currencies(spark, sf):
    per = _fx_day(spark, sf).groupBy("currency_pair", "ticker").agg(F.sum("exposure_amount").alias("exposure"), F.sum("total_pnl").alias("pnl"), F.max("value_at_risk").alias("worst_var"))
    return views.top_each(per, ["currency_pair"], 20, F.desc("exposure"), "ticker")


@query("Q11_bond_ticker", "ticker bond_id sector credit_rating coupon_rate:3 maturity_years price:3 yield_to_maturity:6 credit_spread:4 implied_pd_annual:8 market_value:1 outstanding_pct:4", f"SELECT * FROM {_BD}")
def q11_ticker(spark, sf):
    return V.last_day(M.bond_table(spark, sf))


def _commodity_day(spark, sf) -> DataFrame:
    """The commodity table's last date, by manager: a manager has the share of a name's exposure that it has of its shares."""
    x = Staged()
    held = x.positions(spark, sf)
    total = held.groupBy("ticker").agg(F.sum("shares").alias("_all"))
    day = M.commodity_table(spark, sf, x, 1)
    part = F.col("shares") / F.col("_all")
    return day.join(held, "ticker").join(total, "ticker").withColumns({"exposure_amount": F.col("exposure_amount") * part, "commodity_pnl": F.col("commodity_pnl") * part})


_CMM = f"(SELECT ticker, commodity, asset_manager, VaR_95, VaR_99, hedge_ratio, sensitivity, exposure_amount * shares / tot AS exposure_amount, commodity_pnl * shares / tot AS commodity_pnl FROM (SELECT * FROM {_CM}) JOIN positions USING (ticker) JOIN (SELECT ticker, sum(shares) AS tot FROM positions GROUP BY 1) USING (ticker))"
_CMV = "sum(exposure_amount) AS exposure, sum(commodity_pnl) AS pnl, min(VaR_95 * exposure_amount) AS var95, min(VaR_99 * exposure_amount) AS var99, avg(hedge_ratio) AS avg_hedge, avg(sensitivity) AS avg_sensitivity, count(DISTINCT asset_manager) AS managers, count(DISTINCT commodity) AS commodities"


@query("Q12_commodity_ticker", "ticker commodity exposure:1 pnl:1 var95:1 var99:1 avg_hedge:6 avg_sensitivity:6 managers", f"SELECT ticker, commodity, {_CMV} FROM {_CMM} GROUP BY 1, 2")
def q12_ticker(spark, sf):
    return views.commodity_view(_commodity_day(spark, sf), ["ticker", "commodity"])


@query("Q12_commodity_manager", "asset_manager commodity exposure:1 pnl:1 var95:1 var99:1", f"SELECT asset_manager, commodity, {_CMV} FROM {_CMM} GROUP BY 1, 2")
def q12_manager(spark, sf):
    return views.commodity_view(_commodity_day(spark, sf), ["asset_manager", "commodity"])


@query("Q12_commodity_names", "commodity ticker exposure:1 pnl:1 avg_hedge:6 managers", _top(f"SELECT commodity, ticker, {_CMV} FROM {_CMM} GROUP BY 1, 2", "commodity", 20, "exposure DESC, ticker"))
def q12_names(spark, sf):
    return views.top_each(views.commodity_view(_commodity_day(spark, sf), ["commodity", "ticker"]), ["commodity"], 20, F.desc("exposure"), "ticker")


_DRV = "sum(notional) AS notional, sum(net_exposure) AS net_exposure, sum(greatest(coalesce(delta, 1), 0) * notional) AS delta_eq, sum(net_exposure) AS margin_call_amount, sum(pnl) AS pnl, count(*) FILTER (margin_call_flag = 1) AS margin_calls, count(*) FILTER (margin_call_flag = 1) > 0 AS margin_stress"


@query("Q13_derivatives_ticker", "date ticker notional:1 net_exposure:1 margin_call_amount:1 pnl:1 margin_calls margin_stress", f"SELECT date, ticker, {_DRV} FROM dr GROUP BY 1, 2")
def q13_ticker(spark, sf):
    return views.derivative_view(M.derivatives_table(spark, sf), ["date", "ticker"])


@query("Q13_derivatives_ticker_class", "date ticker asset_class notional:1 net_exposure:1 margin_call_amount:1 pnl:1 margin_calls margin_stress", f"SELECT date, ticker, asset_class, {_DRV} FROM dr GROUP BY 1, 2, 3")
def q13_class(spark, sf):
    return views.derivative_view(M.derivatives_table(spark, sf), ["date", "ticker", "asset_class"])


_CLV = "sum(exposure_before_collateral) AS exposure, sum(required_collateral) AS required, sum(effective_collateral) AS effective, sum(net_exposure) AS net_exposure, avg(collateral_ratio) AS collateral_ratio, count(*) FILTER (margin_call_flag = 1) AS margin_calls, count(*) FILTER (margin_call_flag = 1) > 0 AS margin_stress"


def _collateral(spark, sf, keys: list[str]) -> DataFrame:
    return views.collateral_view(M.collateral_table(spark, sf), keys).withColumnsRenamed({"exposure_before_collateral": "exposure", "required_collateral": "required", "effective_collateral": "effective"})


@query("Q14_collateral_ticker", "date ticker exposure:1 required:1 effective:1 net_exposure:1 collateral_ratio:6 margin_calls margin_stress", f"SELECT date, ticker, {_CLV} FROM cl GROUP BY 1, 2")
def q14_ticker(spark, sf):
    return _collateral(spark, sf, ["date", "ticker"])


@query("Q14_collateral_ticker_class", "date ticker asset_class exposure:1 required:1 effective:1 net_exposure:1 collateral_ratio:6 margin_calls margin_stress", f"SELECT date, ticker, asset_class, {_CLV} FROM cl GROUP BY 1, 2, 3")
def q14_class(spark, sf):
    return _collateral(spark, sf, ["date", "ticker", "asset_class"])


@query("Q14_stress_events", "date ticker asset_class trade_id counterparty jurisdiction agreement_type required_collateral:1 effective_collateral:1 margin_call_amount:1 collateral_ratio:6", "SELECT * FROM cl WHERE margin_call_flag = 1")
def q14_events(spark, sf):
    return M.collateral_table(spark, sf).where("margin_call_flag = 1")


def _observed(spark, sf) -> Column:
    """The month of the last issue, as one value."""
    return X.loans(spark, sf).agg(F.trunc(F.max("issue_date"), "month")).scalar()


def _loans(spark, sf) -> DataFrame:
    """All loans that are open in the last observed month."""
    return q_market.loan_table(spark, sf).where(F.col("month") == _observed(spark, sf))


@query("Q15_loans_ticker", "ticker loan_count notional:1 expected_loss:1 pnl:2 avg_stage:6 predicted_spread:6 ifrs_status", f"SELECT ticker, count(*) AS loan_count, sum(notional_usd) AS notional, sum(expected_loss) AS expected_loss, sum(total_pnl) AS pnl, avg(stage) AS avg_stage, avg(pred_credit_spread) AS predicted_spread, CASE WHEN bool_and(stage = 1) THEN 'All Loans Performing (Stage 1)' WHEN bool_or(stage = 3) THEN 'Default Loans Present (Stage 3)' ELSE 'Mixed Credit Quality' END AS ifrs_status FROM ({_LN}) GROUP BY 1")
def q15_ticker(spark, sf):
    return views.loans_by_ticker(_loans(spark, sf))


@query("Q15_loan", "loan_id ticker month notional_usd:2 stage time_to_maturity_months:5 PD:8 expected_loss:2 total_pnl:3", _LN)
def q15_loan(spark, sf):
    return _loans(spark, sf)


def _last(name: str) -> str:
    return f"(SELECT * FROM {name} WHERE date = (SELECT max(date) FROM {name}))"


_SEGMENTS = {
    "Equity": (_last("eq"), "sum(mtm_value)", "sum(daily_pnl)", "avg(volatility_21d)", "daily_return < -0.04 OR altman_z < 1.8"),
    "FX": (_last("fx"), "sum(exposure_amount)", "sum(total_pnl)", "avg(fx_volatility)", "value_at_risk > 1000000"),
    "Commodities": (_last("cm"), "sum(exposure_amount)", "sum(commodity_pnl)", "sum(VaR_95)", "daily_return < -0.05"),
    "Bonds": (_last("bd"), "sum(market_value)", "CAST(0.0 AS DOUBLE)", "avg(yield_to_maturity)", "credit_spread > 450 OR implied_pd_annual > 0.05"),
    "Derivatives": (_last("dr"), "sum(notional)", "sum(pnl)", "avg(tenor_years)", "margin_call_flag = 1"),
    "Collateral": (_last("cl"), "sum(exposure_before_collateral)", "CAST(0.0 AS DOUBLE)", "avg(haircut)", "margin_call_flag = 1 OR collateral_ratio < 1.0"),
    "Loans": (f"({_LN})", "sum(notional_usd)", "sum(total_pnl)", "avg(volatility_index)", "volatility_index > 0.7"),
}


@query("Q16_all_segments", "segment exposure:1 pnl:2 risk:5 alerts light", "SELECT *, CASE WHEN alerts > 2 THEN 'red' WHEN alerts > 0 OR pnl < 0 THEN 'yellow' ELSE 'green' END AS light FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS segment, coalesce({e}, 0.0) AS exposure, coalesce({p}, 0.0) AS pnl, {r} AS risk, count(*) FILTER (coalesce({a}, false)) AS alerts FROM {t}" for n, (t, e, p, r, a) in _SEGMENTS.items()) + ")")
def q16_all(spark, sf):
    x = Staged().for_trades(spark, sf)
    made = M.trade_frames(spark, sf, x)
    days = {"Equity": M.equity_day(spark, sf, x), "FX": M.fx_since(spark, sf, 1, x), "Commodities": M.commodity_table(spark, sf, x, 1), "Bonds": V.last_day(M.bond_table(spark, sf, x)), "Derivatives": V.last_day(M.derivatives_table(spark, sf, made)), "Collateral": V.last_day(M.collateral_table(spark, sf, made)), "Loans": _loans(spark, sf)}
    return views.segments({n: (days[n], *map(F.expr, (e, p, r, a))) for n, (_, e, p, r, a) in _SEGMENTS.items()})


#: A segment's table, date, value, warning and hard limit, and what breaks it besides.
_RULES = (
    ("Firm", "eq", "date", "max(daily_portfolio_VaR_99)", 0.015, 0.02, "false"),
    ("Equities", "eq", "date", "avg(daily_VaR_99)", 0.015, 0.02, "false"),
    ("FX", "fx", "date", "avg(VaR_99)", 1_000_000.0, 1_500_000.0, "false"),
    ("Bonds", "bd", "date", "avg(credit_spread)", 200.0, 300.0, "false"),
    ("Commodities", "cm", "date", "avg(VaR_99)", 1_300_000.0, 2_000_000.0, "false"),
    ("Derivatives", "dr", "date", "sum(margin_call_amount)", 1_000_000.0, 2_000_000.0, "count_if(margin_call_flag = 1) > 10"),
    ("Collateral", "clm", "date", "sum(net_exposure)", 1_500_000.0, 3_000_000.0, "count_if(margin_call_flag = 1) > 8"),
    ("Loans", "ln", "month", "sum(expected_loss)", 3_500_000.0, 5_000_000.0, "false"),
)
_TABLES = {"clm": f"({S.q_market._CM})", "ln": f"(SELECT * FROM ({q_market.LOANS_SQL}) WHERE month <= {_OBSERVED})", "dr": "(SELECT *, net_exposure AS margin_call_amount FROM dr)"}


def _limit_sql(name, table, date, value, warn, hard, broken) -> str:
    rows = f"(SELECT *, dense_rank() OVER (ORDER BY {date} DESC) AS age FROM {_TABLES.get(table, table)})"
    return f"SELECT CASE age WHEN 1 THEN 'Live' ELSE 'Archive' END AS mode, '{name}' AS segment, coalesce({value}, 0.0) AS actual, {warn} AS warn, {hard} AS hard, {broken} AS broken FROM {rows} WHERE age <= 2 GROUP BY age"


_STATUS = "CASE WHEN broken OR actual > hard THEN 'Hard Breach' WHEN actual > warn THEN 'Warning' ELSE 'Compliant' END"


@query("Q17_all_limits", "mode segment actual:4 status score:1", f"SELECT *, CAST(greatest(50.0, 100.0 - 8 * count(*) FILTER (status <> 'Compliant') OVER (PARTITION BY mode)) AS DOUBLE) AS score FROM (SELECT *, {_STATUS} AS status FROM ({' UNION ALL '.join(_limit_sql(*r) for r in _RULES)}))")
def q17_all(spark, sf):
    x = Staged().for_trades(spark, sf)
    made = M.trade_frames(spark, sf, x)
    frames = {
        "eq": M.equity_since(spark, sf, 2, x),
        "fx": M.fx_since(spark, sf, 2, x),
        "bd": tables.latest_dates(M.bond_table(spark, sf, x), 2),
        "cm": M.commodity_table(spark, sf, x, 2),
        "dr": M.derivatives_table(spark, sf, made),
        "clm": trades.collateral_model(M.collateral_table(spark, sf, made)),
        "ln": q_market.loan_table(spark, sf).where(F.col("month").between(F.add_months(_observed(spark, sf), -1), _observed(spark, sf))),
    }
    each = []
    for name, table, date, value, warn, hard, broken in _RULES:
        per = frames[table].groupBy(date).agg(F.coalesce(F.expr(value), F.lit(0.0)).alias("actual"), F.coalesce(F.expr(broken), F.lit(False)).alias("broken"))
        age = F.row_number().over(W.over([], F.desc(date)))  # a row for each of few dates
        per = per.withColumn("_age", age).where("_age <= 2")
        each.append(per.select(F.when(F.col("_age") == 1, "Live").otherwise("Archive").alias("mode"), F.lit(name).alias("segment"), "actual", F.lit(warn).alias("warn"), F.lit(hard).alias("hard"), "broken"))
    return views.limits(reduce(DataFrame.unionByName, each))


_HELD = "(SELECT event_type AS ticker, 'M' || (user_id % 7) AS asset_manager, sum(abs(value)) AS shares FROM events GROUP BY 1, 2)"


def _held(spark, sf) -> DataFrame:
    """Positions in the instruments that tick: what users traded of them, by groups of users."""
    return X.table(spark, sf, "events").groupBy(F.col("event_type").alias("ticker"), F.concat(F.lit("M"), (F.col("user_id") % 7).cast("string")).alias("asset_manager")).agg(F.sum(F.abs("value")).alias("shares"))


def _live(spark, sf) -> DataFrame:
    snap = intraday.latest_snapshot(intraday.metrics(X.ticks(spark, sf), "ticker", S._ORDER, minutes=S._MIN), "ticker")
    return intraday.intraday_exposure(snap, _held(spark, sf), ("asset_manager",)).where("asset_manager is not null")


_SNAPPED = f"SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY ticker ORDER BY n DESC) AS r FROM ({S.METRICS}) m) JOIN {_HELD} USING (ticker) WHERE r = 1"
_POS = f"SELECT ticker, asset_manager, shares, shares * c AS exposure, shares * (c - pcl) AS pnl, shares * c / nullif(sum(shares * c) OVER (PARTITION BY asset_manager), 0) AS weight, c AS price, CASE WHEN na >= 2 THEN ra END AS return_1m, CASE WHEN nc >= 2 THEN vol END AS vol_15m FROM ({_SNAPPED})"


@query("Q20_ticker_manager", "ticker asset_manager shares:2 exposure:2 pnl:2 weight:6 price:4 return_1m:6 vol_15m:6", _POS)
def q20_manager(spark, sf):
    df = _live(spark, sf).withColumn("weight", W.ratio(F.col("intraday_exposure"), F.col("portfolio_intraday_exposure")))
    return df.withColumnsRenamed({"intraday_exposure": "exposure", "intraday_pnl": "pnl", "close": "price"})


@query("Q18_all_managers", "asset_manager exposure:2 pnl:2 tickers", f"SELECT asset_manager, sum(exposure) AS exposure, sum(pnl) AS pnl, count(DISTINCT ticker) AS tickers FROM ({_POS}) GROUP BY 1")
def q18_all(spark, sf):
    return _live(spark, sf).groupBy("asset_manager").agg(F.sum("intraday_exposure").alias("exposure"), F.sum("intraday_pnl").alias("pnl"), F.count_distinct("ticker").alias("tickers"))


def _fx_live(spark, sf) -> DataFrame:
    last = intraday.latest_snapshot(intraday.fx_metrics(X.ticks(spark, sf), "ticker", S._ORDER, minutes=S._MIN), "ticker", stale_minutes=30).withColumnRenamed("ticker", "currency_pair")
    held = _held(spark, sf).select(F.col("ticker").alias("currency_pair"), F.col("asset_manager").alias("who"), F.col("shares").alias("daily_exposure"))
    return fx.fx_intraday_exposure(last, held)


_FXPOS = f"SELECT ticker AS currency_pair, asset_manager AS who, shares AS e, shares * CASE WHEN na >= 2 THEN ra END AS pnl, shares * CASE WHEN nc >= 2 THEN vol END * 1.65 AS v, r FROM (SELECT m.*, row_number() OVER (PARTITION BY ticker ORDER BY n DESC) AS r FROM ({S.METRICS.replace('- 119', '- 59')}) m) JOIN {_HELD} USING (ticker) WHERE r = 1"


@query("Q22_fx_overview", "currency_pair exposure:2 pnl:3 worst_var:3 holders", f"SELECT currency_pair, sum(e) AS exposure, sum(pnl) AS pnl, max(v) AS worst_var, count(*) AS holders FROM ({_FXPOS}) GROUP BY 1")
def q22_overview(spark, sf):
    return _fx_live(spark, sf).groupBy("currency_pair").agg(F.sum("daily_exposure").alias("exposure"), F.sum("fx_intraday_pnl").alias("pnl"), F.max("var_95_15m").alias("worst_var"), F.count("*").alias("holders"))


@query("Q22_fx_currency", "currency_pair who exposure:2 pnl:3 var:3", _top(f"SELECT currency_pair, who, e AS exposure, pnl, v AS var FROM ({_FXPOS})", "currency_pair", 5, "exposure DESC, who"))
def q22_currency(spark, sf):
    df = _fx_live(spark, sf).select("currency_pair", "who", F.col("daily_exposure").alias("exposure"), F.col("fx_intraday_pnl").alias("pnl"), F.col("var_95_15m").alias("var"))
    return views.top_each(df, ["currency_pair"], 5, F.desc("exposure"), "who")
