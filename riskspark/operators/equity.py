"""Equity features, enrichment, position and portfolio risk, concentration and liquidity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.functions import windows as W

RISK_FREE, YEAR = 0.05, 252
#: Bars that a bar's features look back: 21 returns, the first of which needs the bar before it.
PAST = 21
LEAST_SIGMA, LEAST_VAR, LEAST_CVAR = 0.01, (0.005, 0.01), (0.007, 0.015)
#: Upper edges of credit ratings by Altman Z.
RATING_EDGES = (0.5, 0.8, 1.23, 1.8, 3.0, 4.2, 5.85, 7.0, 8.15)
RATING_LABELS = ("D", "C", "CC", "CCC", "B", "BB", "BBB", "A", "AA", "AAA")


def features(bars: DataFrame, key: str = "ticker", date: str = "date", risk_free: float = RISK_FREE) -> DataFrame:
    """Returns, volatilities, averages, momentum, volume and risk ratios of daily bars. All windows share one partitioning."""
    w = W.over([key], date)
    close, volume = F.col("close"), F.col("volume")
    df = bars.withColumns({
        "daily_return": W.change(close, w),
        "log_return": W.log_change(close, w),
        "high_low_spread": W.ratio(F.col("high") - F.col("low"), F.col("open")),
        "close_open_diff": W.ratio(close - F.col("open"), F.col("open")),
        "ma_5": W.mean(close, w, 5, 1),
        "ma_20": W.mean(close, w, 20, 1),
        "momentum_5d": W.change(close, w, 5),
        "momentum_20d": W.change(close, w, 20),
        "avg_volume_10d": W.mean(volume, w, 10, 1),
        "vol_change": F.coalesce(W.change(volume, w), F.lit(0.0)),
    })
    r = F.col("daily_return")
    df = df.withColumn("excess_return", r - risk_free / YEAR)
    df = df.withColumns({
        "vol_5d": W.deviation(r, w, 5, 2) * YEAR**0.5,
        "vol_20d": W.deviation(r, w, 20, 5) * YEAR**0.5,
        "volatility_21d": W.deviation(r, w, 21, 5),
        "_down": W.downside_masked(r, w, 21, 5),
        "_excess": W.mean(F.col("excess_return"), w, 21, 5),
    })
    return df.withColumns({
        "sharpe_ratio": W.ratio(F.col("_excess"), F.col("volatility_21d")),
        "sortino_ratio": F.coalesce(W.ratio(F.col("_excess"), F.col("_down")), F.lit(0.0)),
        "downside_risk": F.coalesce("_down", F.lit(0.0)),
    }).drop("_down", "_excess").where(F.col("close").isNotNull())


def financial_enrichment(df: DataFrame) -> DataFrame:
    """Coverage, maturity, Altman Z and rating, cash flow, cash, and market value."""
    debt, assets = F.col("total_debt"), F.col("total_assets")
    # fixed values: the weights of the Altman Z score
    z = (
        1.2 * (assets - debt) / assets
        + 1.4 * F.col("net_income") / assets
        + 3.3 * (F.col("ebitda") - 0.05 * debt) / assets
        + 0.6 * F.col("market_cap") / debt
        + F.col("revenue") / assets
    )
    df = df.withColumns({
        "interest_coverage_proxy": F.when(debt > 0, F.col("ebitda") / (0.05 * debt)),
        "maturity_proxy": F.when(debt > 0, F.col("long_term_debt") / debt),
        "altman_z": F.when((assets > 0) & (debt > 0), z),
        "free_cash_flow": F.col("ebitda") - 0.1 * F.col("revenue"),
        "cash_and_equivalents": assets - debt - 0.5 * F.col("revenue"),
        "mtm_value": F.col("close") * F.col("shares"),
    })
    return df.withColumn("credit_rating", S.bins(F.col("altman_z"), RATING_EDGES, RATING_LABELS))


def tail_weight(z: float, level: float, textbook: bool) -> float:
    """Weight of sigma in a CVaR. The default divides the density by the level itself; textbook divides by the tail."""
    return S.density(z) / ((1 - level) if textbook else level)


def _risk(mu: Column, sigma: Column, textbook: bool) -> dict[str, Column]:
    out = {}
    for k, (name, z, level) in enumerate((("95", S.Z_05, 0.95), ("99", S.Z_01, 0.99))):
        out[f"VaR_{name}"] = S.clip(-(mu + z * sigma), LEAST_VAR[k])
        out[f"CVaR_{name}"] = S.clip(-mu + sigma * tail_weight(z, level, textbook), LEAST_CVAR[k])
    return out


def _joined(df: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """df with the other columns of rows, one row for each value of the keys (null too), that go to all tasks."""
    own = {k: f"_key_{k}" for k in keys}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(name)) for k, name in own.items()])
    return df.join(F.broadcast(rows.withColumnsRenamed(own)), same).drop(*own.values())


def _share(x: Column, total: Column) -> Column:
    return F.coalesce(W.ratio(x, total), F.lit(0.0))


def position_weights(df: DataFrame) -> DataFrame:
    """portfolio_weight and beta_weighted of position_risk() alone. Market values are added up by (asset_manager, date), and the sums, a row each, go
    to all tasks, so that no position is shuffled to its group."""
    keys = ["asset_manager", "date"]
    df = _joined(df, df.groupBy(*keys).agg(F.sum("mtm_value").alias("_total")), *keys)
    df = df.withColumns({"portfolio_weight": _share(F.col("mtm_value"), F.col("_total")), "beta": F.coalesce("beta", F.lit(0.0))})
    return df.withColumn("beta_weighted", F.col("portfolio_weight") * F.col("beta")).drop("_total")


def _of_positions(df: DataFrame, textbook: bool) -> DataFrame:
    """What position_risk() tells of a position without its group."""
    df = df.withColumns({
        "daily_pnl": F.col("mtm_value") * F.col("daily_return"),
        "beta": F.coalesce("beta", F.lit(0.0)),
        "daily_sigma": F.greatest(F.coalesce("volatility_21d", "vol_20d", "vol_5d", F.lit(LEAST_SIGMA)), F.lit(LEAST_SIGMA)),
        "daily_mu": F.coalesce("daily_return", F.lit(0.0)),
    })
    return df.withColumns({f"daily_{k}": v for k, v in _risk(F.col("daily_mu"), F.col("daily_sigma"), textbook).items()})


def position_risk(df: DataFrame, textbook: bool = False) -> DataFrame:
    """Profit, weights, exposures, beta and VaR of positions in (asset_manager, date)."""
    group = W.over(["asset_manager", "date"])
    sector, industry = W.over(["asset_manager", "date", "sector"]), W.over(["asset_manager", "date", "industry"])
    df = _of_positions(df, textbook).withColumn("portfolio_weight", _share(F.col("mtm_value"), F.sum("mtm_value").over(group)))
    df = df.withColumn("beta_weighted", F.col("portfolio_weight") * F.col("beta"))
    return df.withColumns({
        "sector_exposure": F.sum("portfolio_weight").over(sector),
        "industry_exposure": F.sum("portfolio_weight").over(industry),
        "sector_beta_weighted": F.sum("beta_weighted").over(sector),
    })


def _named(c: str) -> Column:
    """A text for each value of a column, null too, as keys of a map are not null."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def position_risk_by_sums(df: DataFrame, textbook: bool = False) -> DataFrame:
    """position_risk() of whole tables. Market values are added up by (asset_manager, date, sector, industry); a row for each (asset_manager, date) with maps of its sectors and industries goes to all
    tasks, so that no position is shuffled to its group. The number of such rows does not grow with the positions. df is worked out once more for the sums."""
    keys = ["asset_manager", "date"]
    df = _of_positions(df, textbook).withColumns({"_s": _named("sector"), "_i": _named("industry")})
    sums = df.groupBy(*keys, "_s", "_i").agg(F.sum("mtm_value").alias("_value"), F.sum(F.col("mtm_value") * F.col("beta")).alias("_beta"))
    total = lambda c, *more: F.sum(c).over(W.over([*keys, *more]))
    sums = sums.withColumn("_total", total("_value")).withColumns({"_in_sector": _share(total("_value", "_s"), F.col("_total")), "_beta": _share(total("_beta", "_s"), F.col("_total")), "_in_industry": _share(total("_value", "_i"), F.col("_total"))})
    entries = lambda *of: F.map_from_entries(F.collect_set(F.struct(*of)))
    groups = sums.groupBy(*keys).agg(F.first("_total").alias("_total"), entries("_s", F.struct("_in_sector", "_beta").alias("_of")).alias("_sectors"), entries("_i", "_in_industry").alias("_industries"))
    df = _joined(df, groups, *keys).withColumns({"portfolio_weight": _share(F.col("mtm_value"), F.col("_total")), "_sector": F.col("_sectors")[F.col("_s")]})
    return df.withColumns({
        "beta_weighted": F.col("portfolio_weight") * F.col("beta"),
        "sector_exposure": F.col("_sector._in_sector"),
        "industry_exposure": F.col("_industries")[F.col("_i")],
        "sector_beta_weighted": F.col("_sector._beta"),
    }).drop("_s", "_i", "_total", "_sector", "_sectors", "_industries")


def portfolio_risk(df: DataFrame, textbook: bool = False) -> DataFrame:
    """Mean, volatility (no correlation), VaR, CVaR and profit of each (asset_manager, date), on its rows."""
    group = W.over(["asset_manager", "date"])
    df = df.withColumns({
        "daily_portfolio_mu": F.sum(F.col("portfolio_weight") * F.col("daily_mu")).over(group),
        "daily_portfolio_volatility": F.greatest(F.sqrt(F.sum((F.col("portfolio_weight") * F.col("daily_sigma")) ** 2).over(group)), F.lit(LEAST_SIGMA)),
        "portfolio_daily_pnl": F.sum("daily_pnl").over(group),
    })
    return df.withColumns({f"daily_portfolio_{k}": v for k, v in _risk(F.col("daily_portfolio_mu"), F.col("daily_portfolio_volatility"), textbook).items()})


def _turnover(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "turnover_ratio": F.coalesce(W.ratio(F.col("volume"), F.col("shares")), F.lit(0.0)),
        "_amihud": W.ratio(F.abs("daily_return"), F.coalesce("avg_volume_10d", F.lit(0.0))),
    })


def concentration_liquidity(df: DataFrame, per_sector: bool = False) -> DataFrame:
    """Top-5 weight, sector concentration, illiquidity, turnover and liquidity score. The default concentration sums a
    sector's square once for each of its rows; per_sector sums it once."""
    keys = ["asset_manager", "date"]
    group = W.over(keys)
    square = F.col("sector_exposure") ** 2
    if per_sector:
        square = square / F.count("*").over(W.over([*keys, "sector"]))
    df = _turnover(df).withColumns({
        "top_5_exposure": W.top_sum(F.col("portfolio_weight"), keys, 5, "ticker"),
        "hhi_sector": F.sum(square).over(group),
    })
    return df.withColumns({
        "diversification_score": W.ratio(F.lit(1.0), F.col("hhi_sector")),
        "liquidity_risk_score": F.coalesce(W.scaled(F.col("_amihud"), group), F.lit(0.0)),
        "amihud_illiquidity": F.coalesce("_amihud", F.lit(0.0)),
    }).drop("_amihud")


def concentration_liquidity_by_sums(df: DataFrame, per_sector: bool = False) -> DataFrame:
    """concentration_liquidity() of whole tables, from market values. Groups are added up to a row for each (asset_manager, date), that goes to all tasks, and each task sends its five largest
    positions of a group, so that no other is shuffled. df is worked out once more for the sums and once more for the largest."""
    keys = ["asset_manager", "date"]
    df = _turnover(df)
    sums = df.groupBy(*keys, "sector").agg(F.sum("mtm_value").alias("_value"), F.count("*").alias("_n"), F.min("_amihud").alias("_low"), F.max("_amihud").alias("_high"))
    sums = sums.withColumn("_total", F.sum("_value").over(W.over(keys)))
    square = _share(F.col("_value"), F.col("_total")) ** 2 * (F.lit(1) if per_sector else F.col("_n"))
    groups = sums.groupBy(*keys).agg(F.first("_total").alias("_total"), F.sum(square).alias("hhi_sector"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    named = _joined(df.select("ticker", *keys, "mtm_value"), groups, *keys).withColumn("_weight", _share(F.col("mtm_value"), F.col("_total")))
    largest = named.withColumn("_rank", F.row_number().over(W.over(keys, F.desc_nulls_last("_weight"), "ticker"))).where("_rank <= 5")
    groups = largest.groupBy(*keys).agg(F.sum("_weight").alias("top_5_exposure"), *[F.first(c).alias(c) for c in ("hhi_sector", "_low", "_high")])
    df, x = _joined(df, groups, *keys), F.col("_amihud")
    return df.withColumns({
        "diversification_score": W.ratio(F.lit(1.0), F.col("hhi_sector")),
        "liquidity_risk_score": F.when(x.isNotNull(), F.coalesce(W.ratio(x - F.col("_low"), F.col("_high") - F.col("_low")), F.lit(0.0))).otherwise(F.lit(0.0)),
        "amihud_illiquidity": F.coalesce("_amihud", F.lit(0.0)),
    }).drop("_amihud", "_low", "_high")


def lagged(df: DataFrame, keys: list[str]) -> DataFrame:
    """Returns of 1, 5 and 20 rows before."""
    w = W.over(keys, "date")
    return df.withColumns({f"ret_lag{n}": F.lag("daily_return", n).over(w) for n in (1, 5, 20)})


def inference_features(df: DataFrame, macro: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Lagged returns, weighted lag, means of market and sector by date (computed at their own grain and joined back: a row for each sector and date, that goes to all tasks).

    names: the tickers' days of df, a row each, if they are at hand before they meet positions; df then has their lags (lagged()), as a ticker's are those of its positions."""
    if names is None:
        df = lagged(df, ["asset_manager", "ticker"])
        names = df.dropDuplicates(["ticker", "date"])
    df = df.withColumn("weight_lag_return", F.col("portfolio_weight") * F.col("ret_lag1"))
    means = {k: v for k, v in {"daily_return": "sector_mean", "momentum_20d": "sector_mom20", "volatility_21d": "sector_vol21", "turnover_ratio": "sector_turnover"}.items() if k in names.columns}
    sectors = names.groupBy(F.col("sector").alias("_sector"), F.col("date").alias("_day")).agg(*[F.avg(k).alias(v) for k, v in means.items()], F.sum("daily_return").alias("_sum"), F.count("daily_return").alias("_n"))
    day = W.over(["_day"])  # a row a sector
    sectors = sectors.withColumn("market_mean", W.ratio(F.sum("_sum").over(day), F.sum("_n").over(day))).drop("_sum", "_n")
    sectors = sectors.withColumns({v: F.when(F.col("_sector").isNotNull(), F.col(v)) for v in means.values()})  # tickers without a sector have the market's mean alone
    df = df.join(F.broadcast(sectors), F.col("sector").eqNullSafe(F.col("_sector")) & (F.col("date") == F.col("_day")), "left").drop("_sector", "_day")
    if macro is not None:
        trend = macro.withColumn("gdp_trend", W.difference(F.col("gdp"), W.over([], "month"), 3)).select(F.col("month").alias("_month"), "gdp_trend")  # one row a month
        df = df.join(F.broadcast(trend), F.trunc("date", "month") == F.col("_month"), "left").drop("_month")
    return df
