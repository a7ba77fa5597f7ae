"""Serving queries: what a risk dashboard reads, as functions of asset-class tables and a scenario table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.operators.aggregates import safe_ratio
from riskspark.operators.stress import stressed
from riskspark.operators.tables import latest_dates


def last_day(df: DataFrame, date: str = "date") -> DataFrame:
    return latest_dates(df, 1, date)


def _weighted(value: str, weight: str = "mtm_value") -> Column:
    return F.sum(F.col(weight) * F.col(value))


def equity_overview(df: DataFrame, cases: DataFrame) -> DataFrame:
    """Totals of a day under every scenario."""
    out = df.agg(
        F.sum("mtm_value").alias("total_exposure"), F.sum("daily_pnl").alias("daily_pnl"), _weighted("daily_VaR_95").alias("var_95"), _weighted("daily_VaR_99").alias("var_99"), _weighted("daily_CVaR_95").alias("cvar_95"),
        _weighted("daily_CVaR_99").alias("cvar_99"), F.avg("daily_mu").alias("expected_return"), F.avg("daily_sigma").alias("ex_ante_volatility"), F.avg("diversification_score").alias("diversification_score"),
        F.avg("hhi_sector").alias("hhi_sector"), F.count_distinct("ticker").alias("ticker_count"), F.count_distinct("asset_manager").alias("manager_count"),
    )
    return stressed(out, cases, "total_exposure", ["daily_pnl"], ["var_95", "var_99", "cvar_95", "cvar_99"], ["ex_ante_volatility"], ["expected_return"])


def top_managers(df: DataFrame, cases: DataFrame, k: int = 10) -> DataFrame:
    """The largest managers with share of book, VaR usage, names and concentration alerts."""
    total = df.agg(F.sum("mtm_value").alias("_total"))
    per = df.groupBy("asset_manager").agg(F.sum("mtm_value").alias("exposure"), F.sum("daily_pnl").alias("daily_pnl"), F.count_distinct("ticker").alias("ticker_count"), _weighted("daily_VaR_95").alias("_var"), F.count_if(F.col("portfolio_weight") > 0.05).alias("alerts"))
    per = per.join(F.broadcast(total)).withColumns({"book_pct": safe_ratio(F.col("exposure"), F.col("_total")), "var_usage_pct": safe_ratio(F.col("_var"), F.col("exposure"))}).drop("_var", "_total")
    return stressed(per.orderBy(F.desc("exposure"), "asset_manager").limit(k), cases, "exposure", ["daily_pnl"], ["var_usage_pct"])


def risk_drivers(df: DataFrame, by: str = "var", k: int = 5) -> DataFrame:
    """The k names that matter most by var, loss or exposure."""
    per = df.where("mtm_value > 0").groupBy("ticker", "sector").agg(F.sum("mtm_value").alias("exposure"), F.sum("daily_pnl").alias("daily_pnl"), _weighted("daily_VaR_95").alias("var"), _weighted("volatility_21d").alias("vol"))
    order = {"var": F.desc("var"), "loss": F.asc("daily_pnl"), "exposure": F.desc("exposure")}[by]
    return per.orderBy(order, "ticker").limit(k)


def equity_alerts(df: DataFrame, vol: float = 1.0, k: int = 5) -> DataFrame:
    """Concentration breaches and liquidity spikes, k of each."""
    kinds = (("Concentration Limit Breach", "High", "portfolio_weight", 0.05), ("Liquidity Risk Spike", "Medium", "amihud_illiquidity", 0.5 / vol))
    rows = [df.where(F.col(c) > limit).orderBy(F.desc(c), "ticker", "asset_manager").limit(k).select(F.lit(name).alias("alert"), F.lit(grade).alias("severity"), "ticker", "asset_manager") for name, grade, c, limit in kinds]
    return reduce(DataFrame.unionByName, rows)


def manager_holdings(df: DataFrame, manager: str, k: int = 20) -> DataFrame:
    """A manager's largest positions."""
    return df.where(F.col("asset_manager") == manager).orderBy(F.desc("mtm_value"), "ticker").limit(k).select("ticker", "sector", "mtm_value", "portfolio_weight", "daily_pnl", "daily_VaR_95", "credit_rating")


def manager_overview(df: DataFrame) -> DataFrame:
    """Each manager's exposure, profit, portfolio risk and worst position."""
    return df.groupBy("asset_manager").agg(F.sum("mtm_value").alias("exposure"), F.sum("daily_pnl").alias("daily_pnl"), F.max("daily_portfolio_VaR_95").alias("portfolio_var"), F.min("daily_pnl").alias("worst"), F.max("top_5_exposure").alias("top_5"), F.count_if(F.col("portfolio_weight") > 0.05).alias("alerts"))


def ticker_detail(df: DataFrame) -> DataFrame:
    """Each name's last two days side by side, with risk and fundamentals."""
    from riskspark.functions import windows as W

    one = df.dropDuplicates(["ticker", "date"])
    w = W.over(["ticker"], "date")
    out = one.withColumns({"prev_close": F.lag("close").over(w), "prev_volume": F.lag("volume").over(w), "_last": F.max("date").over(W.over(["ticker"]))})
    return out.where("date = _last").select("ticker", "date", "close", "prev_close", "volume", "prev_volume", "volatility_21d", "amihud_illiquidity", "altman_z", "credit_rating")


def ticker_aggregate(df: DataFrame) -> DataFrame:
    """Each name over its managers, and its share of the book."""
    total = df.agg(F.sum("mtm_value").alias("_total"))
    per = df.groupBy("ticker").agg(F.sum("mtm_value").alias("exposure"), F.sum("daily_pnl").alias("daily_pnl"), F.count_distinct("asset_manager").alias("managers"))
    return per.join(F.broadcast(total)).withColumn("share", safe_ratio(F.col("exposure"), F.col("_total"))).drop("_total")


def position_alerts(df: DataFrame) -> DataFrame:
    """Positions that break a rule of weight, rating or volatility."""
    kinds = F.array_compact(F.array(F.when(F.col("portfolio_weight") > 0.05, "weight"), F.when(F.col("altman_z") < 1.8, "distress"), F.when(F.col("daily_sigma") > 1.0, "volatility")))
    return df.select("ticker", "asset_manager", F.explode(kinds).alias("alert"))


def fx_overview(df: DataFrame, k: int = 7) -> DataFrame:
    """Exposure, risk and profit of currency pairs."""
    per = df.groupBy("currency_pair").agg(F.sum("exposure_amount").alias("exposure"), F.sum("total_pnl").alias("pnl"), F.avg("fx_volatility").alias("volatility"), F.min("value_at_risk").alias("worst_var"), F.max("value_at_risk").alias("largest_var"), F.avg("hedge_ratio").alias("hedge_ratio"), F.count_distinct("ticker").alias("tickers"))
    return per.orderBy(F.desc("exposure"), "currency_pair").limit(k)


def fx_currency(df: DataFrame, pair: str, k: int = 20) -> DataFrame:
    """The names most exposed to a pair."""
    return df.where(F.col("currency_pair") == pair).groupBy("ticker").agg(F.sum("exposure_amount").alias("exposure"), F.sum("total_pnl").alias("pnl"), F.max("value_at_risk").alias("worst_var")).orderBy(F.desc("exposure"), "ticker").limit(k)


def bond_overview(df: DataFrame, k: int = 5) -> DataFrame:
    """The k bonds with the largest default probability, spread and maturity."""
    rows = [df.orderBy(F.desc(c), "bond_id").limit(k).select(F.lit(c).alias("driver"), "bond_id", "ticker", F.col(c).cast("double").alias("value")) for c in ("implied_pd_annual", "credit_spread", "maturity_years")]
    return reduce(DataFrame.unionByName, rows)


def grouped(df: DataFrame, keys: list[str], sums: dict[str, str], flags: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Sums and counted flags of groups."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(k) for k, c in sums.items()], *[F.count_if(c).alias(k) for k, c in flags.items()], F.count("*").alias("n"))


def loan_overview(df: DataFrame) -> DataFrame:
    """Loans of a month by stage, with the stage's name."""
    named = F.when(F.col("stage") == 1, "Stage 1 (performing)").otherwise("Stage 2 (significant increase in risk)")
    return df.groupBy("stage").agg(F.sum("EAD").alias("ead"), F.sum("expected_loss").alias("expected_loss"), F.avg("PD").alias("mean_pd"), F.count("*").alias("n")).withColumn("stage_text", named)


def dashboard(segments: dict[str, tuple[DataFrame, Column, Column, Column, Column]]) -> DataFrame:
    """A row for each segment: exposure, profit, a risk value, alerts, and a light by alerts. segments: name to (day's rows, exposure, profit, risk, alert)."""
    rows = [df.agg(F.lit(name).alias("segment"), e.alias("exposure"), p.alias("pnl"), r.alias("risk"), F.count_if(F.coalesce(a, F.lit(False))).alias("alerts"), F.count("*").alias("_n")) for name, (df, e, p, r, a) in segments.items()]
    share = F.col("alerts") / F.nullif("_n", F.lit(0))
    return reduce(DataFrame.unionByName, rows).withColumn("light", F.when(share > 0.2, "red").when(share > 0.05, "yellow").otherwise("green")).drop("_n")


def compliance(actuals: DataFrame, limits: DataFrame) -> DataFrame:
    """Limits and actual values (segment, actual) with a status, and the score of all: 100 less 8 per breach, 50 at least."""
    status = F.when(F.col("actual") > F.col("hard"), "Hard Breach").when(F.col("actual") > F.col("warn"), "Warning").otherwise("Compliant")
    df = actuals.join(F.broadcast(limits), "segment").withColumn("status", status)
    breaches = df.agg(F.count_if(F.col("status") == "Hard Breach").alias("_b"))
    return df.join(F.broadcast(breaches)).withColumn("compliance_score", F.greatest(F.lit(50), 100 - 8 * F.col("_b"))).drop("_b")


def intraday_alerts(df: DataFrame, k: int = 10, vol: float = 0.02, ret: float = 0.008, high: float = 0.015) -> DataFrame:
    """Volatility spikes and return shocks, the largest exposures first."""
    size = F.abs(F.coalesce("return_1m", F.lit(0.0)))
    kinds = F.array_compact(F.array(F.when(F.coalesce("vol_15m", F.lit(0.0)) > vol, F.struct(F.lit("Volatility Spike").alias("type"), F.lit("medium").alias("severity"))), F.when(size > ret, F.struct(F.lit("Return Shock").alias("type"), F.when(size > high, "high").otherwise("medium").alias("severity")))))
    out = df.select("ticker", "asset_manager", "ts", "intraday_exposure", F.explode(kinds).alias("_a")).select("_a.type", "_a.severity", "ticker", "asset_manager", "ts", "intraday_exposure")
    return out.orderBy(F.desc("intraday_exposure"), "ticker", "asset_manager", "type").limit(k)
