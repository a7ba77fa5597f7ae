"""Bond panels, yield series and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.functions import windows as W
from riskspark.operators.aggregates import standard_scores
from riskspark.operators.joins import every_day

#: Volatility by credit rating, in hundredths; others have DEFAULT_VOL.
VOLATILITY = {"AAA": 2, "AA+": 3, "AA": 4, "A+": 5, "A": 6, "A-": 8, "BBB+": 10, "BBB": 12, "BBB-": 15, "BB+": 20, "BB": 25, "B": 35, "CCC": 50}
DEFAULT_VOL, Z_LIMIT = 10, 4.0


def daily_panel(bonds: DataFrame, days: DataFrame, yields: DataFrame | None = None) -> DataFrame:
    """Each bond on each day, with volatility by rating, market value, share outstanding, and the day's yield."""
    table = F.create_map(*[F.lit(x) for kv in VOLATILITY.items() for x in kv])
    df = every_day(bonds, days).withColumns({
        "vol": F.coalesce(F.element_at(table, F.col("credit_rating")), F.lit(DEFAULT_VOL)) / 100.0,
        "market_value": F.col("price") / 100 * 1000 * F.col("units_outstanding"),
        "outstanding_pct": F.when(F.col("units_issued") > 0, F.col("units_outstanding") / F.col("units_issued") * 100),
    })
    return df if yields is None else df.join(yields, "date", "left")


def yield_series(history: DataFrame, observed: DataFrame, days: DataFrame, window: int = 20, fallback: float = 0.0) -> DataFrame:
    """One row a day: newest observation, filled forward and backward with a flag, moving average and distance from it."""
    both = history.withColumn("_new", F.lit(0)).unionByName(observed.withColumn("_new", F.lit(1))).where("dgs10 is not null")
    newest = both.groupBy("date").agg(F.max_by("dgs10", "_new").alias("dgs10"))
    w = W.over([], "date")  # one row a day
    value, flag = W.filled(F.col("dgs10"), w, fallback)
    df = days.select("date").join(newest, "date", "left").select("date", value.alias("dgs10"), F.when(flag == "CONSTANT", "BACKWARD_FILLED").otherwise(flag).alias("fill_method_flag"))
    df = df.withColumn("dgs10_ma", W.mean(F.col("dgs10"), w, window, 1))
    return df.withColumn("dgs10_anom", F.col("dgs10") - F.col("dgs10_ma"))


def anomalies(df: DataFrame, columns: list[str], limit: float = Z_LIMIT) -> DataFrame:
    """A flag for each column: its global standard score is beyond the limit."""
    scores = {c: f"_z_{c}" for c in columns}
    df = standard_scores(df, scores)
    return df.withColumns({f"{c}_anomaly_flag": F.coalesce(F.abs(z) > limit, F.lit(False)) for c, z in scores.items()}).drop(*scores.values())
