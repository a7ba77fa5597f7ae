"""One trade schema of four asset classes, with deterministic counterparties and collateral."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars as S

#: Margins, haircuts, collateral and kinds by asset class. Equity margins differ between derivatives and collateral.
DERIVATIVE_MARGIN = {"FX": 0.05, "Commodity": 0.08, "Bond": 0.04, "Equity": 0.10}
COLLATERAL_MARGIN = {"FX": 0.05, "Commodity": 0.08, "Bond": 0.04, "Equity": 0.12}
HAIRCUT = {"Cash": 0.00, "Treasury": 0.02, "CorporateBond": 0.10, "Equity": 0.15, "CommodityETF": 0.12}
DERIVATIVE_COLLATERAL = {"FX": "Cash", "Commodity": "Treasury", "Bond": "Treasury", "Equity": "Equity"}
KIND = {"FX": "FXFwd", "Commodity": "Futures", "Bond": "IRS", "Equity": "EqFwd"}
#: Counterparties, tenors in years, and agreements with their weights (sums already, for collateral).
COUNTERPARTIES = ("CP_A", "CP_B", "CP_C", "CP_D", "CP_E")
TENORS = (0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0)
DERIVATIVE_AGREEMENTS = (("CSA", "US", 0.45), ("CSA", "UK", 0.25), ("CSA", "EU", 0.20), ("GMRA", "UK", 0.05), ("GMSLA", "US", 0.05))
COLLATERAL_AGREEMENTS = (("CSA", "US", 0.45), ("CSA", "UK", 0.70), ("CSA", "EU", 0.90), ("GMRA", "UK", 0.95), ("GMSLA", "US", 1.00))
#: Collateral types by asset class, with the sums of their weights.
MENU = {
    "FX": (("Cash", 0.70), ("Treasury", 0.95), ("CorporateBond", 1.00)),
    "Commodity": (("Treasury", 0.60), ("Cash", 0.85), ("CommodityETF", 1.00)),
    "Bond": (("Treasury", 0.80), ("Cash", 0.95), ("CorporateBond", 1.00)),
    "Equity": (("Cash", 0.50), ("Treasury", 0.80), ("Equity", 1.00)),
}
#: Hashes of a trade are numbers below this; the numbers of counterparties and tenors divide it, so it holds their hashes too.
HASHES = 10_000
SCHEMA = ("date", "asset_class", "derivative_type", "ticker", "sector", "industry", "underlying_price", "notional", "delta", "gamma", "vega", "asset_manager", "commodity_sym")


def lookup(values: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def trade_schema(df: DataFrame, asset_class: str, price: str | Column, notional: str | Column, greeks: bool = True) -> DataFrame:
    """Rows of one asset class in the common schema; without greeks they are null and filled later."""
    one = lambda x: F.lit(x if greeks else None).cast("double")
    text = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return df.where(F.col("date").isNotNull()).select(
        "date",
        F.lit(asset_class).alias("asset_class"),
        F.lit(KIND[asset_class]).alias("derivative_type"),
        "ticker",
        text("sector").alias("sector"),
        text("industry").alias("industry"),
        col(price).cast("double").alias("underlying_price"),
        F.abs(col(notional).cast("double")).alias("notional"),
        one(1.0).alias("delta"),
        one(0.0).alias("gamma"),
        one(0.0).alias("vega"),
        text("asset_manager").alias("asset_manager"),
        text("commodity").alias("commodity_sym"),
    )


def all_trades(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def trade_id() -> Column:
    """type_ticker_date, then commodity and the first word of the manager where there are any."""
    return S.joined_id(F.col("derivative_type"), F.col("ticker"), S.day_text(F.col("date")), F.regexp_replace("commodity_sym", "=", "_"), S.first_word(F.col("asset_manager")))


def agreement(share: Column, pool, fixed: bool) -> tuple[Column, Column]:
    """Kind and jurisdiction by a share from 0 to 1. The weights are summed as they are listed; fixed takes them as sums already."""
    steps, total = [], 0.0
    for kind, place, weight in pool:
        total = weight if fixed else total + weight
        steps.append(((kind, place), total))
    return S.ladder(share, [(k[0], e) for k, e in steps]), S.ladder(share, [(k[1], e) for k, e in steps])


def _exposures(df: DataFrame, notional: str) -> DataFrame:
    """Collateral and net exposure; needs margin_rate and haircut."""
    df = df.withColumn("exposure_before_collateral", F.abs(notional))
    df = df.withColumn("required_collateral", F.col("exposure_before_collateral") * F.col("initial_margin_rate"))
    df = df.withColumn("collateral_value", F.col("required_collateral") * 0.9)
    df = df.withColumn("effective_collateral", F.col("collateral_value") * (1 - F.col("haircut")))
    df = df.withColumn("net_exposure", S.clip(F.col("exposure_before_collateral") - F.col("effective_collateral"), 0))
    return df.withColumns({
        "collateral_ratio": F.when(F.col("exposure_before_collateral") > 0, F.col("effective_collateral") / F.col("exposure_before_collateral")).otherwise(0.0),
        "margin_call_flag": F.coalesce(F.col("net_exposure") > 0, F.lit(False)).cast("int"),
        "margin_call_amount": F.col("net_exposure"),
    })


def derivative_trades(trades: DataFrame) -> DataFrame:
    """Identity, margin, exposure, greeks, maturity and profit proxy of the trades of all_trades()."""
    df = trades.withColumn("trade_id", trade_id())
    df, number = df.withColumn("_hash", S.stable_hash(F.col("trade_id"), HASHES)), F.col("_hash")  # one hash for all that the id decides
    kind, place = agreement(number / float(HASHES), DERIVATIVE_AGREEMENTS, False)
    df = df.withColumns({
        "counterparty": S.pick(COUNTERPARTIES, number % len(COUNTERPARTIES)),
        "agreement_type": kind,
        "jurisdiction": place,
        "tenor_years": S.pick(TENORS, number % len(TENORS)),
        "initial_margin_rate": lookup(DERIVATIVE_MARGIN, F.col("asset_class")),
        "collateral_type": lookup(DERIVATIVE_COLLATERAL, F.col("asset_class")),
    }).drop("_hash")
    df = _exposures(df.withColumn("haircut", lookup(HAIRCUT, F.col("collateral_type"))), "notional")
    bare = F.col("delta").isNull() & F.col("gamma").isNull() & F.col("vega").isNull()
    df = df.withColumns({"delta": F.when(bare, 1.0).otherwise(F.col("delta")), "gamma": F.when(bare, 0.0).otherwise(F.col("gamma")), "vega": F.when(bare, 0.0).otherwise(F.col("vega"))})
    # one row of statistics, in one pass over the trades
    spreads = {k: F.stddev_samp(F.when(F.col("asset_class") == k, F.col("underlying_price"))) for k in KIND}
    stats = df.agg(*[F.percentile(c, 0.5).alias(f"_{c}") for c in ("delta", "gamma", "vega")], *[v.alias(f"_spread_{k}") for k, v in spreads.items()])
    df = df.join(F.broadcast(stats))
    own = F.coalesce(*[F.when(F.col("asset_class") == k, F.col(f"_spread_{k}")) for k in KIND])
    df = df.withColumns({"_spread": own, "_top": F.greatest(*[F.col(f"_spread_{k}") for k in KIND])})
    df = df.withColumns({c: F.greatest(F.coalesce(c, f"_{c}"), F.lit(0.0)) for c in ("delta", "gamma", "vega")})
    df = df.withColumn("delta_equivalent_exposure", F.col("delta") * F.col("notional"))
    scale = F.col("_spread") / F.when(F.col("_top") > 0, F.col("_top")).otherwise(1.0)
    df = df.withColumns({"maturity_date": S.years_later(F.col("date"), F.col("tenor_years")), "pnl": F.col("delta_equivalent_exposure") * 0.001 * scale})
    return df.drop("_delta", "_gamma", "_vega", "_spread", "_top", *[f"_spread_{k}" for k in KIND], "commodity_sym", "asset_manager")


def collateral_detail(trades: DataFrame, fixed: bool = False) -> DataFrame:
    """Collateral of the trades of all_trades(), its type, agreement and reuse chosen by hashes of the trade id.

    The default sums agreement weights that are sums already, so only the first two agreements occur; fixed takes them as meant."""
    df, key = trades.withColumn("trade_id", trade_id()), F.col("trade_id")
    share = lambda text: S.stable_hash(F.concat(key, text), HASHES) / float(HASHES)
    df = df.withColumns({"_agreement": share(F.lit("agreement")), "_type": share(F.col("asset_class"))})
    kind, place = agreement(F.col("_agreement"), COLLATERAL_AGREEMENTS, fixed)
    menu = S.once(F.col("_type"), lambda x: F.coalesce(*[F.when(F.col("asset_class") == name, S.ladder(x, steps)) for name, steps in MENU.items()]))
    df = df.withColumns({
        "sector": F.coalesce("sector", F.lit("Unknown")),
        "industry": F.coalesce("industry", F.lit("Unknown")),
        "counterparty": S.pick(COUNTERPARTIES, S.stable_hash(key, len(COUNTERPARTIES))),
        "agreement_type": kind,
        "jurisdiction": place,
        "collateral_type": menu,
        "initial_margin_rate": lookup(COLLATERAL_MARGIN, F.col("asset_class")),
        "reuse_flag": (S.stable_hash(F.concat(key, F.lit("reuse")), 10_000) < 3500).cast("int"),
        "collateral_id": F.md5(key.cast("binary")),
    }).drop("_agreement", "_type")
    df = _exposures(df.withColumn("haircut", lookup(HAIRCUT, F.col("collateral_type"))), "notional")
    cost = F.col("haircut") + F.col("initial_margin_rate")
    return df.withColumns({
        "reused_value": F.col("collateral_value") * F.col("reuse_flag") * 0.8,
        "funding_cost": F.col("collateral_value") * 0.01 * cost,
        "liquidity_score": 1 - cost,
    }).drop("commodity_sym", "asset_manager", "derivative_type", "underlying_price", "delta", "gamma", "vega")


def collateral_model(detail: DataFrame) -> DataFrame:
    """Collateral by date, class, ticker and counterparty."""
    sums = ["exposure_before_collateral", "required_collateral", "collateral_value", "effective_collateral", "net_exposure", "margin_call_amount", "funding_cost"]
    df = detail.groupBy("date", "asset_class", "ticker", "counterparty").agg(*[F.sum(c).alias(c) for c in sums], F.avg("liquidity_score").alias("liquidity_score"))
    ratio = F.coalesce(F.col("effective_collateral") / F.nullif("exposure_before_collateral", F.lit(0.0)), F.lit(0.0))
    return df.withColumns({"collateral_ratio": ratio, "margin_call_flag": (F.col("net_exposure") > 0).cast("int")})
