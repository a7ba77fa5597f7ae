"""Batch scoring with any scorer, in strict, soft and fallback forms, and with stored models."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[pd.DataFrame], pd.Series]
#: Bytes that a stored model may have; it is sent to every worker.
MOST_BYTES = 1 << 28


@dataclass(frozen=True)
class Model:
    """A stored model: its run, the features it takes in their order, and its bytes."""

    run: str
    features: tuple[str, ...]
    body: bytes


def store(spark: SparkSession, folder: str, run: str, features: Sequence[str], body: bytes) -> None:
    """Keep a model as a run of a folder; a run that is stored again replaces itself."""
    if len(body) > MOST_BYTES:
        raise ValueError(f"a model of more than {MOST_BYTES} bytes")
    spark.createDataFrame([(run, list(features), bytearray(body))], "run string, features array<string>, body binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/model={run}")


def stored(spark: SparkSession, folder: str, run: str | None = None) -> Model:
    """A run's model, or that of the newest run (the last by name)."""
    rows = spark.read.parquet(folder)
    row = (rows.where(F.col("run") == run) if run else rows.orderBy(F.desc("run"))).select("run", "features", "body").first()
    if row is None:
        raise ValueError(f"no model of run {run}")
    return Model(row.run, tuple(row.features), bytes(row.body))


@lru_cache(maxsize=8)
def _loaded(model: Model, load: Callable[[bytes], Scorer]) -> Scorer:
    """Once for each worker, however many batches and partitions it gets."""
    return load(model.body)


def scored_by(df: DataFrame, name: str, model: Model, load: Callable[[bytes], Scorer], strict: bool = False) -> DataFrame:
    """df with a stored model's score, the run it is from (name_model), and what failed (name_error; else null).

    Features have to be columns of numbers: a missing one raises if strict, and is 0 else, as nulls are. A batch that fails, and every batch
    of a model that cannot be loaded, has null scores. load is a function of a module that workers can import."""
    gone = [c for c in model.features if c not in df.columns]
    if strict and gone:
        raise ValueError(f"missing features: {', '.join(gone)}")
    if wrong := [c for c in model.features if c not in gone and not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType))]:
        raise ValueError(f"features that are no numbers: {', '.join(wrong)}")
    inputs = F.struct(*[F.lit(0.0).alias(c) if c in gone else F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in model.features])
    sent = df.sparkSession.sparkContext.broadcast(model)  # bounded by MOST_BYTES

    @F.pandas_udf("score double, error string")
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            try:
                score, error = pd.Series(_loaded(sent.value, load)(x), dtype=float).to_numpy(), None
            except Exception as e:
                score, error = None, f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"score": pd.Series(score, index=range(len(x)), dtype=float), "error": pd.Series([error] * len(x), dtype=object)})

    out = df.withColumn("_scored", apply(inputs))
    return out.withColumns({name: F.col("_scored.score"), f"{name}_model": F.lit(model.run), f"{name}_error": F.col("_scored.error")}).drop("_scored")


def linear_model(body: bytes) -> Scorer:
    """A linear scorer from JSON: intercept and weights by feature."""
    told = json.loads(body)
    return lambda x: told["intercept"] + sum(x[c] * w for c, w in told["weights"].items())


def linear(weights: dict[str, float], intercept: float = 0.0) -> Column:
    """A linear scorer as an expression; it needs no Python worker."""
    out = F.lit(intercept)
    for name, w in weights.items():
        out = out + F.coalesce(F.col(name), F.lit(0.0)) * w
    return out


def scored(df: DataFrame, name: str, features: Sequence[str], scorer: Scorer | Column, strict: bool = False, fallback: Column | None = None) -> DataFrame:
    """df with a score. A missing or null feature is 0 for the scorer (the stored columns stay as they are); strict raises instead.
    A batch in which the scorer fails has null scores, or those of the fallback."""
    gone = [c for c in features if c not in df.columns]
    if strict and gone:
        raise ValueError(f"missing features: {', '.join(gone)}")
    if isinstance(scorer, Column):
        plain = df.withColumns({c: F.lit(0.0) for c in gone})
        if strict:
            null = F.lit(False)
            for c in features:
                null = null | F.col(c).isNull()
            scorer = F.when(F.coalesce(null, F.lit(True)), F.raise_error(F.lit("a feature is null"))).otherwise(scorer)
        out = plain.withColumn("_score", scorer).drop(*gone)
    else:
        inputs = F.struct(*[F.coalesce(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in features])

        @F.pandas_udf("double")
        def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            for x in batches:
                if strict and x.isna().to_numpy().any():
                    raise ValueError("a feature is null")
                try:
                    yield pd.Series(scorer(x.fillna(0.0)), dtype=float)
                except Exception:
                    if strict:
                        raise
                    yield pd.Series([None] * len(x), dtype=float)

        out = df.withColumn("_score", apply(inputs))
    value = F.col("_score") if fallback is None else F.coalesce("_score", fallback)
    return out.withColumn(name, value).drop("_score")


def with_fallback(*columns: str, constant: float | None = None) -> Column:
    """The first column that is not null, then a constant."""
    return F.coalesce(*columns, *([F.lit(constant)] if constant is not None else []))


def encoded(df: DataFrame, column: str, levels: DataFrame, name: str) -> DataFrame:
    """Codes of a dimension (level, code); unknown and null levels have the code of __UNK__."""
    unknown = F.broadcast(levels.where("level = '__UNK__'").agg(F.max("code").alias("_unknown")))  # one row
    known = levels.select(F.col("level").alias("_level"), F.col("code").alias("_code"))
    return df.join(known, F.col(column) == F.col("_level"), "left").join(unknown).withColumn(name, F.coalesce("_code", "_unknown")).drop("_level", "_code", "_unknown")


def argmax(probabilities: Column) -> Column:
    """Zero-based place of the largest entry."""
    return (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int")
