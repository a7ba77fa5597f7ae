"""Currency rates, exposures, hedges and risk. Rolling values are of a pair's days; tickers are joined afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators.joins import as_of, fan_out

YEAR, QUARTER_DAYS = 252, 63
BASE_HEDGE, W_VOL, W_CARRY = 0.10, 0.75, 0.15
Z_95, Z_99 = 1.65, 2.33


def interest_differentials(rates: DataFrame, home: str, pairs: dict[str, str], date: str = "date") -> DataFrame:
    """Home rate less foreign rate as (date, currency_pair, interest_diff), from one column of rates per currency."""
    wide = rates.select(date, *[(F.col(home) - F.col(ccy)).alias(pair) for pair, ccy in pairs.items()])
    return wide.unpivot([date], list(pairs), "currency_pair", "interest_diff").where("interest_diff is not null")


def fx_features(universe: DataFrame, fx: DataFrame, rates: DataFrame, sector_pair: DataFrame) -> DataFrame:
    """Tickers of a sector with their pair's daily rates and the last known interest differential."""
    rated = as_of(fx, rates, "currency_pair", "date", "interest_diff")
    exposed = universe.join(sector_pair, "sector")
    return fan_out(rated, exposed, "currency_pair")


def pair_metrics(rated: DataFrame) -> DataFrame:
    """Returns, volatilities, momentum, carry and scaled risk of a pair by day: (currency_pair, date, fx_rate, interest_diff)."""
    w = W.over(["currency_pair"], "date")
    df = rated.withColumn("fx_return", W.change(F.col("fx_rate"), w))
    r = F.col("fx_return")
    df = df.withColumns({
        "fx_volatility_20d": W.deviation(r, w, 20),
        "fx_volatility_30d": W.deviation(r, w, 30),
        "downside_risk_20d": W.downside_clipped(r, w, 20),
        "momentum_5d": W.change(F.col("fx_rate"), w, 5),
        "momentum_20d": W.change(F.col("fx_rate"), w, 20),
    }).withColumn("sharpe_ratio_20d", W.ratio(r, F.col("fx_volatility_20d")))
    df = df.where(r.isNotNull())
    blend = 0.7 * F.coalesce("fx_volatility_20d", F.lit(0.0)) + 0.3 * F.coalesce("fx_volatility_30d", F.lit(0.0))
    df = df.withColumn("fx_volatility_blend", blend)
    df = df.withColumn("fx_volatility", W.smoothed(F.col("fx_volatility_blend"), w, 10))
    df = df.withColumns({"carry_daily": F.col("interest_diff") / 100 / YEAR, "vol_scaled": W.scaled(F.col("fx_volatility"), W.over(["currency_pair"]))})
    df = df.withColumn("return_carry_adj", r + F.col("carry_daily"))
    size = F.abs("interest_diff")
    stats = df.agg(F.min(size).alias("_low"), F.max(size).alias("_high"), F.percentile("vol_scaled", 0.5).alias("_median"))
    df = df.join(F.broadcast(stats))  # one row
    spread = F.when(F.col("_high") > F.col("_low"), F.col("_high") - F.col("_low")).otherwise(1.0)
    df = df.withColumn("int_scaled", 1 - (size - F.col("_low")) / spread)
    df = df.withColumn("hedge_ratio_raw", BASE_HEDGE + W_VOL * F.col("vol_scaled") + W_CARRY * F.col("int_scaled"))
    hedge = 0.5 * S.sigmoid(6 * (F.col("vol_scaled") - F.col("_median"))) + 0.5 * F.col("hedge_ratio_raw")
    df = df.withColumn("hedge_ratio", S.clip(hedge, 0, 1)).drop("_low", "_high", "_median")
    return df.withColumn("is_warmup", F.col("fx_volatility_20d").isNull() | F.col("fx_volatility_30d").isNull())


def fx_enrichment(metrics: DataFrame, exposed: DataFrame) -> DataFrame:
    """Positions, hedged exposure, VaR and profit of each exposed ticker, without warm-up rows.

    exposed: (ticker, sector, industry, revenue, currency_pair, foreign_ratio)."""
    df = fan_out(metrics.where("not is_warmup"), exposed, "currency_pair")
    df = df.withColumn("position_size", F.col("revenue") / QUARTER_DAYS * F.col("foreign_ratio"))
    df = df.withColumn("exposure_amount", F.col("position_size") * (1 - F.col("hedge_ratio")))
    at_risk = F.col("position_size") * F.col("fx_volatility")
    df = df.withColumns({
        "VaR_95": at_risk * Z_95,
        "VaR_99": at_risk * Z_99,
        "value_at_risk": at_risk * Z_99,
        "volume": 0.25 * F.col("position_size"),
        "fx_pnl": F.col("exposure_amount") * F.col("fx_return"),
        "carry_pnl": F.col("exposure_amount") * F.col("carry_daily"),
    })
    df = df.withColumn("total_pnl", F.col("fx_pnl") + F.coalesce("carry_pnl", F.lit(0.0)))
    return df.withColumns({"expected_pnl": F.col("total_pnl"), "sharpe_like_ratio": F.when(F.abs(at_risk) >= 1e-8, F.col("total_pnl") / at_risk)}).drop("is_warmup")


def fx_universe(universe: DataFrame, sector_pair: DataFrame) -> DataFrame:
    """Tickers with their pair and daily exposure."""
    return universe.join(sector_pair, "sector").withColumn("daily_exposure", F.col("revenue") / QUARTER_DAYS * F.col("foreign_ratio"))


def fx_intraday_exposure(metrics: DataFrame, exposed: DataFrame) -> DataFrame:
    """Pair metrics fanned out to exposed tickers: profit of the last minute and VaR of fifteen minutes."""
    out = metrics.join(exposed, "currency_pair")
    return out.withColumns({"fx_intraday_pnl": F.col("daily_exposure") * F.col("fx_return_1m"), "var_95_15m": F.col("daily_exposure") * F.col("fx_vol_15m") * Z_95})
