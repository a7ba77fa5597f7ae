"""Table maintenance on Parquet: appends, partition replacement, merges, rolling layers and serving tables.

What a change of a table leaves is told by functions of the old and the new rows; partitioned.py writes such changes part by part."""

from __future__ import annotations

import os
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators.quality import QualityError


def hourly(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with their New York date and hour."""
    at = S.eastern(F.col(ts))
    return df.withColumns({"date": F.to_date(at), "hour": F.hour(at)})


def append_hourly(df: DataFrame, path: str, mode: str, ts: str = "ts") -> None:
    """Append under a folder for the mode (live, backfill, replay), by New York date and hour."""
    hourly(df, ts).write.partitionBy("date", "hour").mode("append").parquet(f"{path}/{mode}")


def dead_letters(df: DataFrame, key: str, batch_id: str, run_id: str, mode: str, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and dead letters of the others with the original row as JSON."""
    places = [c for c in ("topic", "partition", "offset") if c in df.columns]
    bad = df.where(F.col(error).isNotNull())
    letters = bad.select(F.col(error).alias("error"), F.col(key).alias("key"), *places, F.to_json(F.struct(*[c for c in df.columns if c != error])).alias("original"), F.lit(batch_id).alias("batch_id"), F.lit(run_id).alias("run_id"), F.lit(mode).alias("mode"))
    return df.where(F.col(error).isNull()).drop(error), letters


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """A layer's dates under a run."""
    df.withColumn("run_id", F.lit(run_id)).write.partitionBy("date", "run_id").mode("append").parquet(path)


class Runs:
    """A layer of dates and runs with a pointer: the run that holds a date's rows now is the last one that finished it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, df: DataFrame, run_id: str) -> None:
        """Write a layer's dates under a run, then point its dates to it. A run that is tried again overwrites itself."""
        df.write.partitionBy("date").mode("overwrite").parquet(f"{self.path}/runs/run_id={run_id}")
        done = self.spark.read.parquet(f"{self.path}/runs/run_id={run_id}").select("date").distinct()
        done.select("date", F.lit(run_id).alias("run_id"), F.current_timestamp().alias("at")).write.mode("overwrite").parquet(f"{self.path}/latest/{run_id}")

    def latest(self) -> DataFrame:
        """The run of each date."""
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.path}/latest").groupBy("date").agg(F.max_by("run_id", F.struct("at", "run_id")).alias("run_id"))

    def read(self) -> DataFrame:
        """Each date's rows of its latest run."""
        return self.spark.read.parquet(f"{self.path}/runs").join(self.latest(), ["date", "run_id"], "left_semi")


def rolled(old: DataFrame | None, new: DataFrame, keys: list[str], days: int, date: str = "date") -> DataFrame:
    """Rolling layer: new rows replace old ones of the same key, and the last so many distinct dates stay."""
    both = new.withColumn("_age", F.lit(0))
    if old is not None:
        both = both.unionByName(old.withColumn("_age", F.lit(1)), allowMissingColumns=True)
    one = both.withColumn("_rank", F.row_number().over(W.over(keys, "_age"))).where("_rank = 1").drop("_rank", "_age")
    return latest_dates(one, days, date)


def latest_dates(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the last n distinct dates."""
    dates = df.select(date).distinct().orderBy(F.desc(date)).limit(n)
    return df.join(F.broadcast(dates), date, "left_semi")


def since(dates: DataFrame, n: int, date: str = "date") -> Column:
    """If a row is of the last n distinct dates of a frame, or later: one value, worked out with the query."""
    last = dates.select(date).distinct().orderBy(F.desc_nulls_last(date)).limit(n)
    return F.col(date) >= last.agg(F.min(date)).scalar()


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share. Where none is named, a session whose
    executors are in the driver's process takes a folder of its own; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(f"file:{os.path.abspath(os.environ.get('TMPDIR', '/tmp'))}/spark-{uuid.uuid4().hex}")
        folder = context.getCheckpointDir()
    return folder


def written(df: DataFrame) -> DataFrame:
    """A frame that several results read, worked out once: a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def staged(df: DataFrame, key: str | None = None, *order: str, parts: int | None = None) -> DataFrame:
    """A frame that several results read, as a table in the shared folder: scans of it prune columns, push filters and know its size. With a key
    it is in buckets of the key, sorted within, so that windows and joins by the key need no shuffle; parts: how many, else as many as the session says."""
    spark = df.sparkSession
    name, parts = f"staged_{uuid.uuid4().hex}", parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = f"{shared_folder(spark)}/{name}"
    if key is None:
        df.write.parquet(at)
        return spark.read.parquet(at)
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).sortBy(key, *order).option("path", at).saveAsTable(name)
    return spark.table(name)


#: Rows of a part that is dealt by a key, about.
ROWS = 1_000_000


def parts(df: DataFrame) -> int | None:
    """How many parts to deal the rows of a table into, if spark.sql.shuffle.partitions are too few: what a task holds of a part does not grow with the table. Files tell
    the number of their rows."""
    need = -(-df.count() // ROWS)
    return need if need > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, parts: int | None, *keys: str | Column) -> DataFrame:
    """Rows dealt by keys into so many parts, or as many as the session says."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def with_run_mode(df: DataFrame, mode: str) -> DataFrame:
    """Rows for an append-only history."""
    return df.withColumn("run_mode", F.lit(mode))


def replaced_window(old: DataFrame, new: DataFrame, start: str, end: str, date: str = "date") -> DataFrame:
    """The table with a window of dates replaced, also those that the new rows lack."""
    outside = ~F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return old.where(F.coalesce(outside, F.lit(True))).unionByName(new)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: new rows, and old rows of other keys. Raises if the new rows repeat a key."""
    if not duplicate_keys(new, keys).isEmpty():
        raise QualityError(f"repeated keys ({', '.join(keys)}) in the rows to merge")
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def clean_write(old: DataFrame, new: DataFrame, mode: str, keys: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Backfills replace their window; other modes merge."""
    return replaced_window(old, new, start, end) if mode == "backfill" else merged(old, new, keys)


def replaced_months(old: DataFrame, new: DataFrame, date: str = "date") -> DataFrame:
    """The table with the months of the new rows replaced."""
    months = new.select(F.trunc(date, "month").alias("_m")).distinct()
    return old.join(F.broadcast(months), F.trunc(date, "month") == F.col("_m"), "left_anti").unionByName(new)


def replaced_from(old: DataFrame, new: DataFrame, month: str, date: str = "date") -> DataFrame:
    """The table with everything from a month on replaced."""
    return old.where(F.col(date) < F.lit(month).cast("date")).unionByName(new)


def serving(old: DataFrame | None, new: DataFrame, keys: list[str], date: str = "date", keep: int = 2) -> DataFrame:
    """Serving table: rows of a date are replaced by new ones of the same date, and the last two dates stay."""
    if old is not None:
        new = old.join(F.broadcast(new.select(date).distinct()), date, "left_anti").select(*new.columns).unionByName(new)
    return latest_dates(new, keep, date)


def for_catalog(df: DataFrame, columns: dict[str, str], renamed: dict[str, str]) -> DataFrame:
    """Rename, check, order and cast columns as a catalog lists them; nulls of whole numbers become zero."""
    df = df.withColumnsRenamed(renamed)
    if gone := [c for c in columns if c not in df.columns]:
        raise QualityError(f"missing columns: {', '.join(gone)}")
    whole = (T.IntegerType, T.LongType)
    cast = lambda c, t: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).cast(t) if isinstance(T._parse_datatype_string(t), whole) else F.col(c).cast(t)
    return df.select(*[cast(c, t).alias(c) for c, t in columns.items()])


def union_all(frames: list[DataFrame], missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=missing), frames)


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
