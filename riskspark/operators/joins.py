"""Joins that the built-in ones do not give in one step, and joins to small dimensions.

Sides carry no broadcast hint: Catalyst broadcasts one by its estimated size and adaptive execution by its measured size,
both under spark.sql.autoBroadcastJoinThreshold, so a dimension that grows turns into a shuffled join by itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskspark.functions import windows as W


def to_dimension(df: DataFrame, dimension: DataFrame, on: str | list[str], how: str = "left") -> DataFrame:
    """Join to a dimension."""
    return df.join(dimension, on, how)


def fan_out(days: DataFrame, names: DataFrame, on: str) -> DataFrame:
    """Each row of a few keys' days for each name of the key (inner join). There are too few keys and days to share the work by: days (a row for each key and day,
    whatever the number of names) go to all tasks, and names are dealt evenly, so a task makes the rows of its share of the names."""
    return dealt(names).join(F.broadcast(days), on)


def dealt(names: DataFrame) -> DataFrame:
    """The rows evenly over tasks, where each makes many: a table in one small file is one task's otherwise."""
    return names.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def mapped(df: DataFrame, dimension: DataFrame, on: str, value: str, default) -> DataFrame:
    """Look a value up, with a default where the key is unknown."""
    return to_dimension(df, dimension.select(on, value), on).withColumn(value, F.coalesce(value, F.lit(default)))


def month_join(df: DataFrame, macro: DataFrame, how: str = "inner", date: str = "date", month: str = "month") -> DataFrame:
    """Join daily rows to a monthly table (a few rows a year)."""
    out = df.withColumn("_month", F.trunc(date, "month")).join(macro.withColumnRenamed(month, "_key"), F.col("_month") == F.col("_key"), how)
    return out.drop("_month", "_key")


#: Time of a slot: 365 days of dates, a day of timestamps (in microseconds).
SLOTS = {T.DateType: 365, T.TimestampType: 86_400_000_000}


def as_of(left: DataFrame, right: DataFrame, by: str, order: str, value: str, slot: int | None = None) -> DataFrame:
    """Each left row with the last right value at or before it, per key. Of right rows at one time the largest value counts; null values
    do not count; rows without a time come first; null keys are a key.

    Both sides are one stream ordered by time, dealt into slots of time, so a key with many rows is many tasks' work: a window sees one slot of a key, and the
    last value of the slots before comes from one row a slot. slot: its length, in days of dates, microseconds of timestamps or units of
    numbers (numbers have no default)."""
    kind = left.schema[order].dataType
    length = slot or SLOTS.get(type(kind))
    if not length:
        raise ValueError(f"give the length of a slot of {order}")
    at = F.unix_date(order) if isinstance(kind, T.DateType) else F.unix_micros(order) if isinstance(kind, T.TimestampType) else F.col(order)
    number = F.coalesce(F.floor(at / length).cast("long"), F.lit(-(1 << 62)))
    marked = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)})
    events = right.groupBy(by, order).agg(F.max(value).alias("_value")).withColumn("_side", F.lit(0))
    both = marked.unionByName(events, allowMissingColumns=True).withColumn("_slot", number)
    told = F.when(F.col("_value").isNotNull(), F.struct(order))
    each = both.groupBy(F.col(by).alias("_key"), F.col("_slot").alias("_at")).agg(F.max_by("_value", told).alias("_last"))
    earlier = F.last("_last", ignorenulls=True).over(W.over(["_key"], "_at").rowsBetween(Window.unboundedPreceding, -1))
    each = each.select("_key", "_at", earlier.alias("_before"))
    here = F.last("_value", ignorenulls=True).over(W.over([by, "_slot"], order, "_side").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("_here", here).where("_side = 1")
    found = found.join(each, found[by].eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at")))
    return found.select(*[c for c in left.columns if c != value], F.coalesce("_here", "_before").alias(value))


def outer_chain(series: dict[str, DataFrame], date: str = "date", value: str = "value") -> DataFrame:
    """Full outer join of named series on date: one long union and a pivot instead of a chain of joins."""
    long = reduce(DataFrame.unionByName, [df.select(date, F.lit(name).alias("_name"), F.col(value).alias("_value")) for name, df in series.items()])
    return long.groupBy(date).pivot("_name", list(series)).agg(F.max("_value"))


def active_months(df: DataFrame, start: str, end: str, first: str | None = None, last: str | None = None, number: str | None = None) -> DataFrame:
    """A row for each month start between start and end, instead of a cross join with all months and a range filter. number: a column for the month's place, from 0."""
    month0 = F.when(F.trunc(start, "month") < F.col(start), F.add_months(F.trunc(start, "month"), 1)).otherwise(F.trunc(start, "month"))
    low = F.greatest(month0, F.lit(first).cast("date")) if first else month0
    high = F.least(F.col(end), F.lit(last).cast("date")) if last else F.col(end)
    months = F.when(low <= high, F.sequence(low, high, F.expr("interval 1 month"))).otherwise(F.array().cast("array<date>"))
    return df.select("*", F.posexplode(months).alias(number, "month")) if number else df.withColumn("month", F.explode(months))


def missing(keys: DataFrame, days: DataFrame, actual: DataFrame) -> DataFrame:
    """Every key on every day without a row. The days are a calendar."""
    return keys.join(days).join(actual, [*keys.columns, *days.columns], "left_anti")


def every_day(keys: DataFrame, days: DataFrame) -> DataFrame:
    """Every key on every day of a calendar."""
    return keys.join(days)


def expanded(df: DataFrame, weights: Column, key: str, value: str) -> DataFrame:
    """A row for each entry of a map."""
    return df.select("*", F.explode(weights).alias(key, value))


def filled_key(df: DataFrame, lookup: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Fill a null column from a lookup on the keys."""
    return df.join(lookup.select(*keys, F.col(value).alias("_found")), keys, "left").withColumn(value, F.coalesce(value, "_found")).drop("_found")


def coverage(universe: DataFrame, snapshot: DataFrame, key: str = "ticker", stale: str = "is_stale", ts: str = "ts") -> DataFrame:
    """One row: how many keys of the universe have a row, how many are fresh or stale, and the last update."""
    one = snapshot.groupBy(key).agg(F.max(stale).alias("_stale"), F.max(ts).alias("_ts"))
    return universe.select(key).distinct().join(one, key, "left").agg(
        F.count("*").alias("universe_total"),
        F.count("_ts").alias("valued_count"),
        F.count_if(F.col("_ts").isNull()).alias("missing_count"),
        F.count_if(F.col("_ts").isNotNull() & ~F.col("_stale")).alias("fresh_count"),
        F.count_if(F.col("_ts").isNotNull() & F.col("_stale")).alias("stale_count"),
        F.max("_ts").alias("last_update"),
    )
