"""Commodity features, synthetic days, and exposures of tickers to commodities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators.aggregates import fractional_rank
from riskspark.operators.sliding import rolling_quantiles

ROLL, HISTORY = 60, 3
#: Days of a key in a slot.
SLOT = 512
#: Scale of exposure by commodity; others have DEFAULT_SCALE.
SCALES = {"ECONOMY": 0.8, "STANDARD": 1.2, "PROMO": 0.6, "MEDIUM": 0.9, "LARGE": 0.5}
DEFAULT_SCALE = 0.7


def commodity_features(bars: DataFrame, key: str = "commodity", roll: int = ROLL, sliding: bool = False) -> DataFrame:
    """Returns, volatility, historical VaR by rolling quantiles, and daily profit; rows without a return go. sliding: quantiles from one sorted
    window kept from row to row, for long series; else from frames of rows, which are quicker for short ones."""
    w = W.over([key], "date")
    close = F.col("close")
    df = bars.withColumns({"daily_return": W.change(close, w), "log_return": W.log_change(close, w), "pnl": W.difference(close, w)})
    r = F.col("daily_return")
    df, levels = df.withColumn("vol_20d", W.deviation(r, w, 20) * 252**0.5), {"VaR_95": 0.05, "VaR_99": 0.01}
    df = rolling_quantiles(df, r, levels, key, roll) if sliding else df.withColumns({c: W.quantile(r, w, roll, q) for c, q in levels.items()})
    return df.where(r.isNotNull())


def with_buffer(history: DataFrame, new: DataFrame, key: str, rows: int, date: str = "date") -> DataFrame:
    """New rows after the last `rows` rows of each key's history, marked by is_new: what rolling features need to warm up."""
    first = new.groupBy(key).agg(F.min(date).alias("_first"))
    old = history.join(first, key).where(F.col(date) < F.col("_first")).drop("_first")
    old = old.withColumn("_rank", F.row_number().over(W.over([key], F.desc(date)))).where(F.col("_rank") <= rows).drop("_rank")
    return old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def segments(spine: DataFrame, key: str, number: str, real: str, history: int, carried: list[str], slot: int = SLOT) -> DataFrame:
    """The rows with _segment and _context. A missing row after `history` real ones depends on these alone, so it begins a segment, and has their
    values in _context; segments of a key are worked out apart. number: of a row in its key, without gaps.

    No window is over a whole key: rows are dealt into slots of numbers that begin with the last rows of the slot before, and what earlier
    slots know of the last beginning comes from a row for each slot."""
    own = F.floor(F.col(number) / slot).cast("long")
    ahead = F.when(F.col(number) % slot >= slot - history, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = spine.withColumn("_slot", F.explode(ahead)).withColumn("_own", own)
    within = W.over([key, "_slot"], number)
    before = within.rowsBetween(-history, -1)
    begins = ~F.col(real) & (F.count_if(F.col(real)).over(before) == history)
    dealt = dealt.withColumn("_context", F.when(begins, F.collect_list(F.struct(*carried)).over(before))).where("_slot = _own").drop("_own")
    dealt = dealt.withColumn("_begin", F.when(F.col("_context").isNotNull(), F.col(number)))
    slots = dealt.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_at")).agg(F.max("_begin").alias("_last"))
    slots = slots.withColumn("_earlier", F.max("_last").over(W.over(["_key"], "_at").rowsBetween(Window.unboundedPreceding, -1))).drop("_last")
    here = F.max("_begin").over(within.rowsBetween(Window.unboundedPreceding, 0))
    found = dealt.withColumn("_here", here).join(slots, dealt[key].eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")))
    return found.withColumn("_segment", F.coalesce(F.greatest("_here", "_earlier"), F.lit(-1))).drop("_slot", "_begin", "_here", "_earlier", "_key", "_at")


def synthetic_days(bars: DataFrame, days: DataFrame, key: str = "commodity", history: int = HISTORY, slot: int = SLOT) -> DataFrame:
    """A bar for each day without one: the mean of the last few bars, earlier synthetic ones included, rounded to two digits.

    The fill is sequential within a segment of a key's days (segments()); the segments that begin in one slot are a group."""
    columns = ["open", "high", "low", "close", "volume"]
    if history >= slot:
        raise ValueError("a slot has more rows than the history")
    calendar = days.select("date").distinct().withColumn("_n", F.row_number().over(W.over([], "date")) - 1)  # a row for each day of all
    spine = bars.select(key).distinct().join(calendar).join(bars.select(key, "date", *columns), [key, "date"], "left")
    spine = spine.withColumn("_real", F.col("close").isNotNull()).withColumns({c: F.col(c).cast("double") for c in columns})

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_n").reset_index(drop=True)
        values = pdf[columns].to_numpy(dtype=float, copy=True)
        context = pdf["_context"].tolist()
        made, last = [False] * len(pdf), []
        for i in range(len(pdf)):
            if context[i] is not None:  # a segment begins
                last = [np.array([x[c] for c in columns], float) for x in context[i]]
            if pd.isna(values[i, 3]):
                if not last:
                    continue
                values[i] = [round(float(sum(v[c] for v in last) / len(last)), 2) for c in range(len(columns))]
                made[i] = True
            last = [*last, values[i]][-history:]
        pdf[columns] = values
        pdf["data_quality_flag"] = ["SYNTHETIC" if m else "REAL" for m in made]
        return pdf.loc[pdf["close"].notna(), [key, "date", *columns, "data_quality_flag"]]

    schema = f"{key} {bars.schema[key].dataType.simpleString()}, date date, {', '.join(f'{c} double' for c in columns)}, data_quality_flag string"
    dealt = segments(spine.select(key, "date", "_n", "_real", *columns), key, "_n", "_real", history, columns, slot)
    together = F.floor(F.col("_segment") / slot).cast("long")  # segments that begin in one slot
    return dealt.withColumn("_segment", together).groupBy(key, "_segment").applyInPandas(fill, schema)


def exposed_days(companies: DataFrame, weights: DataFrame, values: DataFrame) -> DataFrame:
    """(commodity, date, _weight): how many exposures a commodity has on a date. Companies are counted by sector before they meet commodities."""
    counted = values.join(companies.select("ticker", "sector"), "ticker").groupBy("sector", "date").agg(F.count("*").alias("_weight"))
    return counted.join(weights.select("sector", "commodity"), "sector").groupBy("commodity", "date").agg(F.sum("_weight").alias("_weight"))


def commodity_exposure(companies: DataFrame, weights: DataFrame, features: DataFrame, values: DataFrame, counts: DataFrame | None = None, when: Column | None = None) -> DataFrame:
    """Exposure, hedge ratio by rank of volatility, and hedged profit of tickers: sector weights, commodity days, daily market values.

    The rank is over all exposures; a commodity's day is ranked once, weighted by its exposures, and exposures are joined once: values of a ticker's days meet its
    commodities, then their days, so there is never a row for a day without a value. counts: exposed_days() of
    the same tables, if they are at hand. when: a condition on the date of the days that are returned; ranks are over all days."""
    counts = exposed_days(companies, weights, values) if counts is None else counts
    ranked = fractional_rank(features.join(counts, ["commodity", "date"]), "vol_20d", "_rank", weight="_weight").drop("_weight")
    if when is not None:
        ranked, values = ranked.where(when), values.where(when)
    df = values.join(companies.join(weights, "sector"), "ticker").join(F.broadcast(ranked), ["commodity", "date"])  # a row for each commodity and day
    df = df.withColumns({"mtm_value": F.coalesce("mtm_value", F.lit(0.0)), "daily_return": F.coalesce("daily_return", F.lit(0.0))})
    scale = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in SCALES.items() for x in kv]), F.col("commodity")), F.lit(DEFAULT_SCALE))
    df = df.withColumns({"hedge_ratio": S.clip(0.2 + 0.6 * F.col("_rank"), 0, 1), "commodity_scale": scale})
    df = df.withColumn("exposure_amount", F.col("sensitivity") * F.col("mtm_value") * F.col("commodity_scale"))
    return df.withColumn("commodity_pnl", F.col("exposure_amount") * F.col("daily_return") * (1 - F.col("hedge_ratio"))).drop("_rank")
