"""Sketches as columns: distinct counts and quantiles that are stored by fine keys and rolled up without their rows.

A sketch has a bounded size, merges in any order, and gives an estimate with a known error, so a total over managers, sectors or the firm
reads sketches of the level below. Exact functions stay the default everywhere else."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Logarithm of the registers of a distinct count, and size of a quantile sketch.
REGISTERS, ITEMS = 12, 200


def count_error(registers: int = REGISTERS) -> float:
    """Relative standard error of a distinct count."""
    return 1.04 / 2 ** (registers / 2)


def rank_error(items: int = ITEMS) -> float:
    """Error of a quantile's rank, as a share of all rows, that about one sketch in a hundred exceeds."""
    return 2.3 / items**0.9021


def sketched(df: DataFrame, keys: Sequence[str], distinct: dict[str, str] | None = None, quantiles: dict[str, str] | None = None, registers: int = REGISTERS, items: int = ITEMS) -> DataFrame:
    """One row a key with sketches (column to name) of distinct values and of doubles. Nulls are in none; a key without values has empty ones."""
    counts = [F.hll_sketch_agg(c, registers).alias(n) for c, n in (distinct or {}).items()]
    orders = [F.kll_sketch_agg_double(F.col(c).cast("double"), items).alias(n) for c, n in (quantiles or {}).items()]
    return df.groupBy(*keys).agg(*counts, *orders)


def rolled(df: DataFrame, keys: Sequence[str], distinct: Sequence[str] = (), quantiles: Sequence[str] = ()) -> DataFrame:
    """Sketches merged to fewer keys; no key at all is the total."""
    return df.groupBy(*keys).agg(*[F.hll_union_agg(n).alias(n) for n in distinct], *[F.kll_merge_agg_double(n).alias(n) for n in quantiles])


def with_counts(df: DataFrame, sketch: str, name: str, registers: int = REGISTERS, deviations: float = 3.0) -> DataFrame:
    """The distinct count of a sketch, with the bounds (name_low, name_high) of so many standard errors."""
    n, far = F.hll_sketch_estimate(sketch), deviations * count_error(registers)
    return df.withColumns({name: n, f"{name}_low": F.floor(n / (1 + far)), f"{name}_high": F.ceil(n / (1 - far))})


def with_quantile(df: DataFrame, sketch: str, name: str, q: float, items: int = ITEMS) -> DataFrame:
    """A quantile of a sketch, with those at its rank less and plus the error (name_low, name_high); null for an empty sketch."""
    full, far = F.kll_sketch_get_n_double(sketch) > 0, rank_error(items)
    at = lambda r: F.when(full, F.kll_sketch_get_quantile_double(sketch, F.lit(min(max(r, 0.0), 1.0))))
    return df.withColumns({name: at(q), f"{name}_low": at(q - far), f"{name}_high": at(q + far)})
