"""Views of a dashboard for all managers, names, pairs or classes at once; a page filters the rows of its key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import windows as W
from riskspark.operators.aggregates import safe_ratio
from riskspark.operators.stress import stressed

RISKS = ("daily_VaR_95", "daily_VaR_99", "daily_CVaR_95", "daily_CVaR_99")


def _in_money(c: str, weight: str = "mtm_value") -> Column:
    return F.sum(F.col(weight) * F.col(c)).alias(c)


def top_each(df: DataFrame, keys: list[str], k: int, *order: Column | str) -> DataFrame:
    """The first k rows of each key."""
    return df.withColumn("_rank", F.row_number().over(W.over(keys, *order))).where(F.col("_rank") <= k).drop("_rank")


def manager_totals(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Each manager under each scenario: exposure and its share of the book, profit, risk in money, names and concentrated positions."""
    book = df.agg(F.sum("mtm_value").alias("_book"))
    per = df.groupBy("asset_manager").agg(F.sum("mtm_value").alias("exposure"), F.sum("daily_pnl").alias("daily_pnl"), *[_in_money(c) for c in RISKS], F.count_if(F.col("portfolio_weight") > 0.05).alias("alerts"), F.count_distinct("ticker").alias("tickers"))
    per = per.join(F.broadcast(book)).withColumn("portfolio_weight", safe_ratio(F.col("exposure"), F.col("_book"))).drop("_book")
    return stressed(per, cases, "exposure", ["daily_pnl"], list(RISKS))


def holdings(df: DataFrame, k: int = 20) -> DataFrame:
    """The k largest positions of each manager, with risk as a share of exposure."""
    per = df.groupBy("asset_manager", "ticker", "sector").agg(F.sum("mtm_value").alias("exposure"), F.sum("portfolio_weight").alias("weight"), F.sum("daily_pnl").alias("daily_pnl"), _in_money("daily_VaR_95"), F.avg("turnover_ratio").alias("turnover_ratio"))
    per = per.withColumn("var_pct", F.coalesce(safe_ratio(F.col("daily_VaR_95"), F.col("exposure")), F.lit(0.0)))
    return top_each(per, ["asset_manager"], k, F.desc("exposure"), "ticker")


def contributors(df: DataFrame, k: int = 5) -> DataFrame:
    """The k names of each manager with the most risk in money."""
    per = df.where("daily_VaR_95 is not null").groupBy("asset_manager", "ticker").agg(F.sum("mtm_value").alias("exposure"), _in_money("daily_VaR_95"))
    return top_each(per, ["asset_manager"], k, F.desc("daily_VaR_95"), "ticker")


def concentrations(df: DataFrame, k: int = 10) -> DataFrame:
    """The k largest names of each manager above a twentieth of its portfolio."""
    per = df.where("portfolio_weight > 0.05").groupBy("asset_manager", "ticker").agg(F.sum("mtm_value").alias("exposure"))
    return top_each(per, ["asset_manager"], k, F.desc("exposure"), "ticker").withColumns({"alert": F.lit("Concentration limit breach"), "severity": F.lit("High")})


def ticker_market(bars: DataFrame) -> DataFrame:
    """Each name's last day, the day before beside it."""
    w = W.over(["ticker"], "date")
    before = ["date", "open", "high", "low", "close", "volume"]
    df = bars.withColumns({f"prev_{c}": F.lag(c).over(w) for c in before} | {"_last": F.lead("date").over(w)}).where("_last is null").drop("_last")
    close, earlier = F.col("close"), F.col("prev_close")
    return df.withColumns({"daily_return": W.ratio(close, earlier) - 1, "log_return": F.log(W.ratio(close, earlier)), "high_low_spread": (F.col("high") - F.col("low")) / F.col("open"), "close_open_diff": (close - F.col("open")) / F.col("open")})


def ticker_risk(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Each name's beta, moments and risk in money over its managers, under each scenario."""
    per = df.groupBy("ticker").agg(*[F.max(c).alias(c) for c in ("beta", "daily_sigma", "daily_mu")], *[_in_money(c) for c in RISKS], F.sum("mtm_value").alias("_exposure"))
    return stressed(per, cases, "_exposure", [], list(RISKS), [], ["daily_mu"]).drop("_exposure")


def of_names(df: DataFrame, columns: list[str], cases: DataFrame | None = None, volatility: list[str] = ()) -> DataFrame:
    """Values of names, the same for all managers; some of them grow with a scenario's volatility."""
    per = df.groupBy("ticker").agg(*[F.first(c, ignorenulls=True).alias(c) for c in columns])
    return per if cases is None else stressed(per, cases, columns[0], volatility=list(volatility))


def position_summary(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Each position under each scenario."""
    per = df.groupBy("ticker", "asset_manager").agg(F.sum("mtm_value").alias("exposure"), F.sum("shares").alias("shares"), F.sum("daily_pnl").alias("daily_pnl"), F.max("portfolio_weight").alias("portfolio_weight"), F.max("close").alias("price"))
    return stressed(per, cases, "exposure", ["daily_pnl"])


def position_intelligence(df: DataFrame) -> DataFrame:
    """Expected profit and risk contribution of each position from its predictions; positions without exposure are left out."""
    per = df.groupBy("ticker", "asset_manager").agg(*[F.max(c).alias(c) for c in ("pred_ret_1d", "pred_ret_5d", "pred_ret_21d", "pred_vol_21d", "pred_var_21d", "beta_weighted", "sector_beta_weighted")], F.max("mtm_value").alias("exposure")).where("coalesce(exposure, 0) <> 0")
    return per.withColumns({f"expected_pnl_{n}": F.col("exposure") * F.coalesce(f"pred_ret_{n}", F.lit(0.0)) for n in ("1d", "5d", "21d")} | {"var_contribution_pct": F.col("pred_var_21d") / F.col("exposure")})


def prediction_alerts(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Positions that break a rule of weight, predicted risk, factor, sector rotation or regime, under each scenario."""
    per = df.groupBy("ticker", "asset_manager").agg(F.max("mtm_value").alias("exposure"), *[F.max(c).alias(c) for c in ("portfolio_weight", "pred_var_21d", "pred_factor_21d", "pred_sector_rotation", "pred_macro_regime")])
    per = stressed(per, cases, "exposure", risk=["pred_var_21d"])
    kinds = (
        ("Concentration", "High", F.col("portfolio_weight") > 0.05),
        ("Risk", "High", F.coalesce("pred_var_21d", F.lit(0.0)) > 0.10 * F.coalesce("exposure", F.lit(0.0))),
        ("Model", "Medium", F.col("pred_factor_21d") < -0.05),
        ("Sector", "Medium", F.col("pred_sector_rotation") < -0.02),
        ("Macro", "Medium", F.col("pred_macro_regime") == 0),
    )
    each = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("type"), F.lit(g).alias("severity"))) for n, g, c in kinds]))
    return per.select("scenario", "ticker", "asset_manager", F.explode(each).alias("_a")).select("scenario", "ticker", "asset_manager", "_a.type", "_a.severity")


def commodity_view(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exposure, profit, the worst VaR in money and means of groups of commodity exposures."""
    return df.groupBy(*keys).agg(
        F.sum("exposure_amount").alias("exposure"), F.sum("commodity_pnl").alias("pnl"), F.min(F.col("VaR_95") * F.col("exposure_amount")).alias("var95"), F.min(F.col("VaR_99") * F.col("exposure_amount")).alias("var99"),
        F.avg("hedge_ratio").alias("avg_hedge"), F.avg("sensitivity").alias("avg_sensitivity"), F.count_distinct("asset_manager").alias("managers"), F.count_distinct("commodity").alias("commodities"),
    )


def derivative_view(df: DataFrame, keys: list[str]) -> DataFrame:
    """Notional, exposure, margin calls and profit of groups of trades."""
    out = df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("notional", "net_exposure", "delta_equivalent_exposure", "margin_call_amount", "pnl")], F.count_if(F.col("margin_call_flag") == 1).alias("margin_calls"))
    return out.withColumn("margin_stress", F.col("margin_calls") > 0)


def collateral_view(df: DataFrame, keys: list[str]) -> DataFrame:
    """Exposure, required and effective collateral and margin calls of groups."""
    out = df.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("exposure_before_collateral", "required_collateral", "effective_collateral", "net_exposure", "margin_call_amount")],
        F.avg("collateral_ratio").alias("collateral_ratio"), F.count_if(F.col("margin_call_flag") == 1).alias("margin_calls"),
    )
    return out.withColumn("margin_stress", F.col("margin_calls") > 0)


def loans_by_ticker(df: DataFrame) -> DataFrame:
    """Loans of each name, with what its stages say."""
    out = df.groupBy("ticker").agg(F.count("*").alias("loan_count"), F.sum("notional_usd").alias("notional"), F.sum("expected_loss").alias("expected_loss"), F.sum("total_pnl").alias("pnl"), F.avg("stage").alias("avg_stage"), F.avg("pred_credit_spread").alias("predicted_spread"), F.every(F.col("stage") == 1).alias("_one"), F.some(F.col("stage") == 3).alias("_three"))
    status = F.when(F.col("_one"), "All Loans Performing (Stage 1)").when(F.col("_three"), "Default Loans Present (Stage 3)").otherwise("Mixed Credit Quality")
    return out.withColumn("ifrs_status", status).drop("_one", "_three")


def segments(rows: dict[str, tuple[DataFrame, Column, Column, Column, Column]]) -> DataFrame:
    """A row for each segment: exposure, profit, a risk value, alerts, and a light: red from three alerts on, yellow with any or a loss.
    rows: name to (day's rows, exposure, profit, risk, alert)."""
    each = [df.agg(F.lit(name).alias("segment"), F.coalesce(e, F.lit(0.0)).alias("exposure"), F.coalesce(p, F.lit(0.0)).alias("pnl"), r.alias("risk"), F.count_if(F.coalesce(a, F.lit(False))).alias("alerts")) for name, (df, e, p, r, a) in rows.items()]
    return reduce(DataFrame.unionByName, each).withColumn("light", F.when(F.col("alerts") > 2, "red").when((F.col("alerts") > 0) | (F.col("pnl") < 0), "yellow").otherwise("green"))


def limits(actuals: DataFrame) -> DataFrame:
    """A status for each (mode, segment, actual, warn, hard, broken), and the score of a mode: 100 less 8 for each breach or warning, 50 at least."""
    status = F.when(F.col("broken") | (F.col("actual") > F.col("hard")), "Hard Breach").when(F.col("actual") > F.col("warn"), "Warning").otherwise("Compliant")
    df = actuals.withColumn("status", status)
    found = F.count_if(F.col("status") != "Compliant").over(W.over(["mode"]))  # a row for each segment
    return df.withColumn("score", F.greatest(F.lit(50.0), 100.0 - 8 * found))
