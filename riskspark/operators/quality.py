"""Data quality: schemas, service levels, drift, thresholds and failure gates."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A gate that did not pass."""


def schema_hash(columns: dict[str, str]) -> str:
    """MD5 of the sorted JSON of a schema."""
    return hashlib.md5(json.dumps(columns, sort_keys=True).encode()).hexdigest()


def enforce_schema(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Cast the declared columns; other columns stay. All missing columns and all failed casts are told at once."""
    if gone := [c for c in columns if c not in df.columns]:
        raise QualityError(f"missing columns: {', '.join(gone)}")
    lost = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).cast("string").try_cast(t).isNull()).alias(c) for c, t in columns.items()]).first()
    if bad := {c: lost[c] for c in columns if lost[c]}:
        raise QualityError("values that cannot be cast: " + ", ".join(f"{c} ({n} to {columns[c]})" for c, n in bad.items()))
    return df.withColumns({c: F.col(c).cast("string").try_cast(t) if dict(df.dtypes)[c] == "string" else F.col(c).cast(t) for c, t in columns.items()})


def sla(df: DataFrame, key: str, expected: int, latest: str, date: str = "date", threshold: float = 0.9) -> DataFrame:
    """One row: coverage of keys, freshness, repeated keys, and PASS or FAIL. Repeats do not fail."""
    per = df.groupBy(key, date).agg(F.count("*").alias("_n"))
    out = per.agg(F.count_distinct(key).alias("keys"), F.max(date).alias("max_date"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"))
    out = out.withColumns({"coverage": F.col("keys") / F.lit(float(expected)) if expected else F.lit(0.0), "fresh": F.coalesce(F.col("max_date") >= F.lit(latest).cast("date"), F.lit(False))})
    return out.withColumn("status", F.when((F.col("coverage") >= threshold) & F.col("fresh"), "PASS").otherwise("FAIL"))


#: name: (column or None for the count of keys, upper bound of the ratio or None, lower bound or None)
EQUITY_DRIFT = {"volume_anomaly": ("volume", 3.0, 0.1), "volatility_spike": ("vol_20d", 2.5, None), "coverage_drop": (None, None, 0.8)}


def drift(new: DataFrame, baseline: DataFrame, key: str, checks: dict = EQUITY_DRIFT) -> DataFrame:
    """Rows (type, current, historical, ratio) of means, or counts of keys, that left their bounds against a baseline."""
    measure = lambda df, side: df.agg(*[(F.avg(c) if c else F.count_distinct(key).cast("double")).alias(f"{side}_{name}") for name, (c, _, _) in checks.items()])
    both = measure(new, "new").join(F.broadcast(measure(baseline, "old")))  # one row each
    rows = F.array(*[F.struct(F.lit(n).alias("type"), F.col(f"new_{n}").alias("current"), F.col(f"old_{n}").alias("historical"), F.lit(hi).cast("double").alias("hi"), F.lit(lo).cast("double").alias("lo")) for n, (_, hi, lo) in checks.items()])
    out = both.select(F.explode(rows).alias("r")).select("r.*").where("historical > 0").withColumn("ratio", F.col("current") / F.col("historical"))
    return out.where("(hi is not null and ratio > hi) or (lo is not null and ratio < lo)").select("type", "current", "historical", "ratio")


def spread_drift(new: DataFrame, baseline: DataFrame, key: str, value: str, level: str, most_ratio: float = 2.0, most_z: float = 2.0, least_keys: float = 0.8) -> DataFrame:
    """Currency checks: ratio of standard deviations, distance of a level's mean in baseline deviations, and coverage of keys."""
    measure = lambda df, s: df.agg(F.stddev_samp(value).alias(f"{s}_spread"), F.avg(level).alias(f"{s}_mean"), F.stddev_samp(level).alias(f"{s}_level"), F.count_distinct(key).alias(f"{s}_keys"))
    both = measure(new, "new").join(F.broadcast(measure(baseline, "old")))  # one row each
    row = lambda name, current, historical, measured, bad: F.struct(F.lit(name).alias("type"), current.cast("double").alias("current"), historical.cast("double").alias("historical"), measured.cast("double").alias("ratio"), bad.alias("bad"))
    c = F.col
    ratio, z, keys = c("new_spread") / F.nullif("old_spread", F.lit(0.0)), F.abs(c("new_mean") - c("old_mean")) / F.nullif("old_level", F.lit(0.0)), c("new_keys") / F.nullif(c("old_keys"), F.lit(0))
    rows = F.array(row("spread_ratio", c("new_spread"), c("old_spread"), ratio, ratio > most_ratio), row("level_shift", c("new_mean"), c("old_mean"), z, z > most_z), row("coverage_drop", c("new_keys"), c("old_keys"), keys, keys < least_keys))
    return both.select(F.explode(rows).alias("r")).select("r.*").where("bad").drop("bad")


def threshold_report(df: DataFrame, required: list[str], invalid) -> DataFrame:
    """One row: rows, share with a null in a required column, share for which invalid holds."""
    null = F.greatest(*[F.col(c).isNull().cast("int") for c in required]) if len(required) > 1 else F.col(required[0]).isNull().cast("int")
    bad = F.coalesce(invalid, F.lit(False)).cast("int")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.avg(null), F.lit(0.0)).alias("null_rate"), F.coalesce(F.avg(bad), F.lit(0.0)).alias("invalid_rate"))


def validated(df: DataFrame, required: list[str], invalid, most_null: float = 0.02, most_invalid: float = 0.01) -> DataFrame:
    """Rows without nulls or invalid values; raises if too many have any."""
    row = threshold_report(df, required, invalid).first()
    for name, most in (("null_rate", most_null), ("invalid_rate", most_invalid)):
        if row[name] > most:
            raise QualityError(f"{name} {row[name]:.2%} is above {most:.2%}")
    return df.dropna(subset=required).where(~F.coalesce(invalid, F.lit(False)))


def failure_gate(failed: int, total: int, most: float = 0.10) -> float:
    """The share that failed; raises beyond the bound."""
    rate = failed / total if total else 0.0
    if rate > most:
        raise QualityError(f"{failed} of {total} failed, more than {most:.0%}")
    return rate


def failure_rate(df: DataFrame, key: str, failed, most: float = 0.10) -> DataFrame:
    """One row: keys, failed keys, their share, and if the gate passes."""
    per = df.groupBy(key).agg(F.max(failed.cast("int")).alias("_failed"))
    out = per.agg(F.count("*").alias("total"), F.coalesce(F.sum("_failed"), F.lit(0)).alias("failed"))
    return out.withColumn("rate", F.coalesce(F.col("failed") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))).withColumn("passes", F.col("rate") <= most)
