"""Aggregates that need more than one function, and global statistics joined back as one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskspark.functions import windows as W


def safe_ratio(a: Column, b: Column) -> Column:
    """Ratio of aggregates, null where the lower one is zero."""
    return a / F.nullif(b, F.lit(0.0))


def with_total(df: DataFrame, value: str, name: str = "share") -> DataFrame:
    """Each row's share of the grand total, a single broadcast row."""
    total = df.agg(F.sum(value).alias("_total"))
    return df.join(F.broadcast(total)).withColumn(name, safe_ratio(F.col(value), F.col("_total"))).drop("_total")


def smallest_mode(x: Column) -> Column:
    """Most frequent value; the smallest of several."""
    return F.mode(x, True)


def first_distinct(x: Column, n: int = 3, by: str = "|") -> Column:
    """The first n distinct texts in order, joined."""
    return F.array_join(F.slice(F.array_sort(F.collect_set(x.cast("string"))), 1, n), by)


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order (give descending columns for the last one)."""
    return df.withColumn("_rank", F.row_number().over(W.over(keys, *order))).where("_rank = 1").drop("_rank")


def standard_scores(df: DataFrame, names: dict[str, str], population: bool = False) -> DataFrame:
    """Global standard scores of several columns (value to name) by one broadcast row of means and deviations; zero where nothing varies."""
    spread = F.stddev_pop if population else F.stddev_samp
    stats = df.agg(*[x for k, v in enumerate(names) for x in (F.avg(v).alias(f"_mean{k}"), spread(v).alias(f"_spread{k}"))])
    score = lambda v, k: F.when(F.col(f"_spread{k}") > 0, (F.col(v) - F.col(f"_mean{k}")) / F.col(f"_spread{k}")).otherwise(F.lit(0.0))
    return df.join(F.broadcast(stats)).withColumns({name: score(v, k) for k, (v, name) in enumerate(names.items())}).drop(*stats.columns)


def standard_score(df: DataFrame, value: str, name: str, population: bool = False) -> DataFrame:
    """Global standard score of one column."""
    return standard_scores(df, {value: name}, population)


def fractional_rank(df: DataFrame, value: str, name: str, parts: int = 200, weight: str | None = None) -> DataFrame:
    """Rank over all rows as a share of non-null ones, ties at their mean; a row counts as `weight` rows. Distinct values are counted, the counts are summed by
    ranges between approximate quantiles, and then inside each range; so no task sorts all rows."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_n"))
    edges = counts.agg(F.percentile_approx("_v", [k / parts for k in range(1, parts)], 10_000).alias("_edges"))  # one row
    ranged = counts.join(F.broadcast(edges)).withColumn("_part", F.size(F.filter("_edges", lambda e: e < F.col("_v")))).drop("_edges")
    sums = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # one row for each range
    before = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(W.over([], "_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_all": F.sum("_sum").over(W.over([]))})
    inside = F.sum("_n").over(W.over(["_part"], "_v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = ranged.join(F.broadcast(before), "_part").select("_v", ((F.col("_before") + inside - F.col("_n") + (F.col("_n") + 1) / 2) / F.col("_all")).alias(name))
    return df.join(ranks, F.col(value) == F.col("_v"), "left").drop("_v")


def month_end(df: DataFrame, date: str, value: str, months: DataFrame) -> DataFrame:
    """Last value of each month of a calendar (month), filled forward and then backward."""
    last = df.where(F.col(value).isNotNull()).groupBy(F.trunc(date, "month").alias("month")).agg(F.max_by(value, date).alias(value))
    out = months.join(last, "month", "left")
    filled, _ = W.filled(F.col(value), W.over([], "month"))  # one row a month
    return out.withColumn(value, filled)


def top_groups(df: DataFrame, by: Column, k: int, *ties: str) -> DataFrame:
    """The first k rows in an order, with ties broken."""
    return df.orderBy(by, *ties).limit(k)
