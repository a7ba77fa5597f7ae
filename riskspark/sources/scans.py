"""Scans: envelopes from streams, replays, newest files and runs, delimited files, watermarks and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BAR = [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
_HEAD = [T.StructField(c, T.StringType()) for c in ("producer_run_id", "batch_id", "source_fetch_time", "producer_pipeline_name", "batch_ts")]
EQUITY_ENVELOPE = T.StructType([*_HEAD, T.StructField("tickers", T.ArrayType(T.StructType([T.StructField("ticker", T.StringType()), *_BAR, T.StructField("volume", T.DoubleType()), T.StructField("timestamp", T.StringType())])))])
FX_ENVELOPE = T.StructType([*_HEAD, T.StructField("bars", T.ArrayType(T.StructType([T.StructField("currency_pair", T.StringType()), *_BAR, T.StructField("timestamp", T.StringType())])))])
COORDINATES = {"topic": "string", "partition": "int", "offset": "long"}


def kafka(spark: SparkSession, servers: str, topic: str, live: bool = True) -> DataFrame:
    """Stream of a topic: from now on if live, else from its start. Needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest" if live else "earliest").option("failOnDataLoss", "false").load()


def files(spark: SparkSession, path: str) -> DataFrame:
    """Stream of text files of envelopes, in the columns of kafka()."""
    df = spark.readStream.format("text").load(path)
    return df.select(F.col("value").cast("binary").alias("value"), F.lit("files").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"))


def decoded(df: DataFrame, envelope: T.StructType = EQUITY_ENVELOPE) -> DataFrame:
    """One row per bar, with the envelope's header, the stream's coordinates and ts."""
    items = envelope.fields[-1].name
    body = F.from_json(F.col("value").cast("string"), envelope)
    keep = [c for c in COORDINATES if c in df.columns]
    rows = df.select(*keep, body.alias("_e")).select(*keep, *[f"_e.{f.name}" for f in envelope.fields[:-1]], F.posexplode(f"_e.{items}").alias("_at", "_x"))
    return rows.select("*", "_x.*").drop("_x").withColumnRenamed("_at", "place").withColumn("ts", F.try_to_timestamp("timestamp"))


def replay(spark: SparkSession, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
    """Parquet of several paths, with the stream's coordinates as nulls where they are missing."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(*paths)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in COORDINATES.items() if c not in df.columns})


def newest_files(spark: SparkSession, path: str, partitions: list[str]) -> DataFrame:
    """Rows of the newest file of each partition of a dataset."""
    df = spark.read.parquet(path).withColumns({"_file": F.col("_metadata.file_path"), "_time": F.col("_metadata.file_modification_time")})
    newest = df.groupBy(*partitions).agg(F.max(F.struct("_time", "_file")).alias("_newest"))
    return df.join(newest, partitions).where(F.col("_file") == F.col("_newest._file")).drop("_file", "_time", "_newest")


def newest_runs(df: DataFrame, date: str = "date", run: str = "run_id", start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows of the newest run of each date; with a range, only those partitions are read."""
    if start is not None:
        df = df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    newest = df.groupBy(date).agg(F.max(run).alias("_newest"))
    return df.join(newest, date).where(F.col(run) == F.col("_newest")).drop("_newest")


def with_record_id(df: DataFrame, key: str, date: str = "date") -> DataFrame:
    """record_id, rebuilt from key and date where it is missing."""
    made = F.concat_ws("_", F.col(key), F.date_format(date, "yyyy-MM-dd"))
    return df.withColumn("record_id", F.coalesce("record_id", made) if "record_id" in df.columns else made)


def day_first_csv(spark: SparkSession, path: str, schema: str, pattern: str = "dd-MM-yyyy") -> DataFrame:
    """Delimited text with a declared schema and day-first dates."""
    return spark.read.csv(path, schema=schema, header=True, dateFormat=pattern)


def after(df: DataFrame, watermark, column: str = "date") -> DataFrame:
    """Rows after a watermark, in a form that reaches the scan."""
    return df if watermark is None else df.where(F.col(column) > F.lit(watermark))


def between(df: DataFrame, start, end, column: str = "date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def from_month(df: DataFrame, month: str, column: str = "date") -> DataFrame:
    """Rows from the start of a month on; the raw column is compared, so files can be skipped."""
    return df.where(F.col(column) >= F.trunc(F.lit(month).cast("date"), "month"))


def watermark(df: DataFrame, default: str, column: str = "date") -> DataFrame:
    """One row: the largest date, or a default."""
    return df.agg(F.coalesce(F.max(F.to_date(column)), F.lit(default).cast("date")).alias("watermark"))


def months_present(df: DataFrame, column: str = "date") -> DataFrame:
    return df.select(F.trunc(column, "month").alias("month")).distinct()


def static_universe(df: DataFrame, drop: list[str], keys: list[str]) -> DataFrame:
    return df.drop(*drop).dropDuplicates(keys)


def with_max_date(df: DataFrame, column: str = "date") -> tuple[DataFrame, DataFrame]:
    """A layer, and its largest date as a frame of one row."""
    return df, df.agg(F.max(column).alias("max_date"))
