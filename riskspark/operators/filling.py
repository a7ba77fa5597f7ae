"""Gaps of long series filled without a window over a whole key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.functions import windows as W

#: Days of a slot.
SLOT = 365


def carried(df: DataFrame, x: Column, key: str, date: str = "date", out: str = "filled", flag: str = "flag", slot: int = SLOT) -> DataFrame:
    """The rows with x filled forward, then backward within each key, and where each value is from (REAL, FORWARD_FILLED, BACKWARD_FILLED, or null).

    Windows are over a key's rows of one slot of days. What goes over from slot to slot, the last value of the slots before and the first of those
    after, comes from one row a slot and is joined back. Rows without a date come first; dates of a key are distinct."""
    number = F.coalesce(F.floor(F.unix_date(F.col(date).cast("date")) / slot).cast("long"), F.lit(-(1 << 40)))
    rows = df.withColumns({"_x": x, "_slot": number})
    told = F.when(F.col("_x").isNotNull(), F.struct(date))
    each = rows.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_at")).agg(F.min_by("_x", told).alias("_first"), F.max_by("_x", told).alias("_last"))
    line = W.over(["_key"], "_at")
    before = F.last("_last", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))
    each = each.select("_key", "_at", before.alias("_before"), after.alias("_after"))
    within = W.over([key, "_slot"], date)
    rows = rows.withColumns({"_ahead": F.last("_x", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "_behind": F.first("_x", ignorenulls=True).over(within.rowsBetween(0, Window.unboundedFollowing))})
    rows = rows.join(each, rows[key].eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")))
    ahead, behind = F.coalesce("_ahead", "_before"), F.coalesce("_behind", "_after")
    source = F.when(F.col("_x").isNotNull(), "REAL").when(ahead.isNotNull(), "FORWARD_FILLED").when(behind.isNotNull(), "BACKWARD_FILLED")
    return rows.select(*[c for c in df.columns if c not in (out, flag)], F.coalesce(ahead, behind).alias(out), source.alias(flag))
