"""Rolling and grouped window expressions. All take columns and return columns; rows() and growing() give the frames.

NaN and infinity count as null at every boundary; a rolling value needs `least` non-null values in its frame."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec


def over(keys: list[str], *order: str | Column) -> WindowSpec:
    w = Window.partitionBy(*keys)
    return w.orderBy(*order) if order else w


def clean(x: Column) -> Column:
    """NaN and infinity as null."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return a / F.when(b != 0, b)


def change(x: Column, w: WindowSpec, n: int = 1) -> Column:
    """Simple return over n rows."""
    return ratio(x, F.lag(x, n).over(w)) - 1


def log_change(x: Column, w: WindowSpec) -> Column:
    return F.log(ratio(x, F.lag(x).over(w)))


def difference(x: Column, w: WindowSpec, n: int = 1) -> Column:
    return x - F.lag(x, n).over(w)


def _rolling(value: Column, x: Column, w: WindowSpec, n: int, least: int | None) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), value.over(frame))


def mean(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    return _rolling(F.avg(x), x, w, n, least)


def deviation(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Sample standard deviation; null for a single value."""
    return _rolling(F.stddev_samp(x), x, w, n, least)


def quantile(x: Column, w: WindowSpec, n: int, q: float, least: int | None = None) -> Column:
    """Exact quantile with linear interpolation."""
    return _rolling(F.percentile(x, q), x, w, n, least)


def downside_masked(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Deviation of the negative values alone."""
    return deviation(F.when(x < 0, x), w, n, least)


def downside_clipped(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Deviation with positive values taken as zero."""
    return deviation(F.when(x > 0, 0.0).otherwise(x), w, n, least)


def jump(x: Column, w: WindowSpec, threshold: float) -> Column:
    """If x moved by more than a share of its last value; false where that is unknown."""
    return F.coalesce(F.abs(change(x, w)) > threshold, F.lit(False))


def filled(x: Column, w: WindowSpec, constant: float | None = None) -> tuple[Column, Column]:
    """x filled forward, then backward, then by a constant; and where each value is from."""
    ahead = F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    value = F.coalesce(ahead, behind, *([F.lit(constant)] if constant is not None else []))
    flag = F.when(x.isNotNull(), "REAL").when(ahead.isNotNull(), "FORWARD_FILLED").when(behind.isNotNull(), "BACKWARD_FILLED")
    return value, flag if constant is None else flag.otherwise("CONSTANT")


def scaled(x: Column, group: WindowSpec) -> Column:
    """Min-max scaling in a group; zero where all are the same."""
    low, high = F.min(x).over(group), F.max(x).over(group)
    return F.when(x.isNotNull(), F.coalesce(ratio(x - low, high - low), F.lit(0.0)))


def top_sum(x: Column, group_by: list[str], n: int, *ties: str) -> Column:
    """Sum of the n largest of a group."""
    rank = F.row_number().over(over(group_by, x.desc_nulls_last(), *ties))
    return F.sum(F.when(rank <= n, x)).over(over(group_by))


def smoothed(x: Column, w: WindowSpec, span: int) -> Column:
    """Exponentially weighted mean, first value as it is; a fold over as many last rows as weigh more than a double's last bit together."""
    alpha = 2.0 / (span + 1)
    memory = max(2, math.ceil(-37 / math.log1p(-alpha))) if alpha < 1 else 2
    values = F.collect_list(x).over(w.rowsBetween(-(memory - 1), 0))
    return F.aggregate(F.slice(values, 2, memory), F.element_at(values, 1), lambda acc, v: acc * (1 - alpha) + v * alpha)
