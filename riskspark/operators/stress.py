"""Stress scenarios as rows: all of them in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Return shift, volatility and VaR multipliers.
SCENARIOS = (
    ("baseline", 0.0, 1.0, 1.0),
    ("risk_on", 0.05, 0.85, 0.80),
    ("risk_off", -0.08, 1.30, 1.40),
    ("equity_rally", 0.10, 0.75, 0.70),
    ("equity_crash", -0.20, 1.80, 1.60),
    ("volatility_spike", -0.05, 2.00, 1.80),
    ("rates_up", -0.06, 1.25, 1.30),
    ("rates_down", 0.04, 0.90, 0.85),
    ("inflation_shock", -0.07, 1.35, 1.40),
    ("stagflation", -0.10, 1.40, 1.30),
    ("gfc_2008", -0.30, 2.20, 2.00),
    ("covid_2020", -0.25, 2.00, 1.80),
)


def scenarios(spark: SparkSession, custom: list[tuple] = ()) -> DataFrame:
    """Named and custom scenarios (name, ret_shift, vol_multiplier, var_multiplier), held in their bounds."""
    df = spark.createDataFrame([*SCENARIOS, *custom], "scenario string, ret_shift double, vol_multiplier double, var_multiplier double")
    hold = lambda c, lo, hi: F.greatest(F.least(c, F.lit(hi)), F.lit(lo))
    return df.withColumns({"ret_shift": hold("ret_shift", -0.30, 0.30), "vol_multiplier": hold("vol_multiplier", 0.3, 3.0), "var_multiplier": hold("var_multiplier", 0.5, 5.0), "is_stressed": F.col("scenario") != "baseline"})


def stressed(df: DataFrame, cases: DataFrame, exposure: str, pnl: list[str] = (), risk: list[str] = (), volatility: list[str] = (), returns: list[str] = ()) -> DataFrame:
    """Every row under every scenario (a few rows, broadcast)."""
    out = df.join(F.broadcast(cases))
    shift = {c: F.col(c) + F.coalesce(exposure, F.lit(0.0)) * F.col("ret_shift") for c in pnl}
    shift |= {c: F.col(c) * F.col("var_multiplier") for c in risk} | {c: F.col(c) * F.col("vol_multiplier") for c in volatility} | {c: F.col(c) + F.col("ret_shift") for c in returns}
    return out.withColumns(shift).drop("ret_shift", "vol_multiplier", "var_multiplier")
