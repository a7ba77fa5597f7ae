"""Row filters, sessions, calendars and column housekeeping."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions import scalars as S
from riskspark.functions import windows as W


def valid_ticks(df: DataFrame, column: str = "volume") -> DataFrame:
    """Ticks with a positive volume (or close)."""
    return df.where(F.col(column) > 0)


def bar_error() -> Column:
    """Why a bar is invalid, or null."""
    return F.when(F.col("close").isNull() | (F.col("close") <= 0), "close is not positive").when(F.col("high") < F.col("low"), "high is below low")


def equity_session(ts: Column) -> Column:
    """09:30 up to 16:00 in New York, Monday to Friday."""
    t = S.eastern(ts)
    at = F.hour(t) * 60 + F.minute(t)
    return (at >= 570) & (at < 960) & F.dayofweek(t).between(2, 6)


def fx_session(ts: Column) -> Column:
    """Sunday 17:00 up to Friday 17:00 in New York."""
    t = S.eastern(ts)
    day, hour = F.dayofweek(t), F.hour(t)
    return day.between(2, 5) | ((day == 1) & (hour >= 17)) | ((day == 6) & (hour < 17))


def not_flat(df: DataFrame) -> DataFrame:
    return df.where(F.col("high") != F.col("low"))


def completed_bars(df: DataFrame, key: str, ts: str, live: bool = True) -> DataFrame:
    """Live: the newest complete bar of a key, the last but one; otherwise all bars."""
    if not live:
        return df
    return df.withColumn("_rank", F.row_number().over(W.over([key], F.desc(ts)))).where("_rank = 2").drop("_rank")


def trading_days(spark: SparkSession, first: str, last: str, holidays: list[str] = ()) -> DataFrame:
    """Monday to Friday without holidays."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    return days.where(F.dayofweek("date").between(2, 6) & ~F.col("date").isin([date.fromisoformat(h) for h in holidays]))


def effective_end(now: datetime, close_hour: int = 16) -> date:
    """The day up to which data is complete: yesterday until the close (now is New York time)."""
    from datetime import timedelta

    return now.date() if now.hour >= close_hour else now.date() - timedelta(days=1)


def on_days(df: DataFrame, days: DataFrame, column: str = "date") -> DataFrame:
    """Rows on days of a calendar."""
    return df.join(days.select(F.col("date").alias(column)), column, "left_semi")


def hard_filter(df: DataFrame, keys: list[str], price: str, volume: str | None = None, floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Rows with keys, a positive price and enough volume; and a row of counts of what fell out."""
    no_key = F.lit(False)
    for k in keys:
        no_key = no_key | F.col(k).isNull()
    bad_price = F.col(price).isNull() | (F.col(price) <= 0)
    thin = F.coalesce(F.col(volume) < floor, F.lit(True)) if volume else F.lit(False)
    counts = df.agg(F.count("*").alias("rows_in"), F.count_if(no_key).alias("null_key"), F.count_if(~no_key & bad_price).alias("bad_price"), F.count_if(~no_key & ~bad_price & thin).alias("thin"))
    return df.where(~(no_key | bad_price | thin)), counts


def run_window(df: DataFrame, mode: str, watermark: str | None = None, start: str | None = None, end: str | None = None, column: str = "date") -> DataFrame:
    """Incremental: after the watermark; otherwise between two days. Both reach the scan."""
    if mode == "incremental":
        return df if watermark is None else df.where(F.col(column) > F.lit(watermark).cast("date"))
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def with_lineage(df: DataFrame, **values) -> DataFrame:
    """Constant columns of a run."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def lineage_to_source(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"source_{c}" for c in columns if c in df.columns})


def without(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.drop(*columns)


def ensured(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns that are missing, as nulls of a type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def allowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The listed columns that exist, in that order."""
    return df.select(*[c for c in columns if c in df.columns])


def contract_keys(df: DataFrame, column: str, longest: int = 10) -> DataFrame:
    """Tidy distinct keys, and whether each is suspiciously long."""
    return df.select(S.tidy(F.col(column)).alias(column)).where(F.col(column).isNotNull()).distinct().withColumn("too_long", F.length(column) > longest)


def for_export(df: DataFrame) -> DataFrame:
    """Dates as text, null numbers as zero, null text as empty."""
    out = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DateType, T.TimestampType)):
            out[f.name] = F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = F.coalesce(c, F.lit(0).cast(f.dataType))
        elif isinstance(f.dataType, T.StringType):
            out[f.name] = F.coalesce(c, F.lit(""))
    return df.withColumns(out)


def rescaled(df: DataFrame, column: str, factor: float, date_column: str = "date") -> DataFrame:
    """A column times a factor and its date as a day."""
    return df.withColumns({column: F.col(column) * factor, date_column: F.to_date(date_column)})
