"""Exact quantiles of sliding windows, from one sorted window that is kept from row to row.

A frame of rows would sort its n values again for every row. Here a row's value is inserted into the sorted window and the one that
leaves is taken out. A key's rows are numbered within slots of days, the numbers before a slot come from the slots' counts, and rows are dealt
by number into chunks that begin with the n - 1 rows before them, so a key of any length is many tasks' work."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskspark.functions import windows as W

#: Rows of a key in a chunk, and days of a slot.
CHUNK, SLOT = 4096, 3650


def window_quantiles(values: np.ndarray, n: int, quantiles: Sequence[float], least: int) -> list[np.ndarray]:
    """For each row the quantiles of the last n values up to it, interpolated; NaN is no value, and with fewer than `least` values there is none."""
    out = [np.full(len(values), np.nan) for _ in quantiles]
    own, line = values.tolist(), []
    for i, x in enumerate(own):
        if i >= n and own[i - n] == own[i - n]:
            del line[bisect_left(line, own[i - n])]
        if x == x:
            insort(line, x)
        if len(line) < max(least, 1):
            continue
        for told, q in zip(out, quantiles, strict=True):
            at = (len(line) - 1) * q
            low, high = int(np.floor(at)), int(np.ceil(at))
            told[i] = line[low] if line[low] == line[high] else (high - at) * line[low] + (at - low) * line[high]
    return out


def rolling_quantiles(df: DataFrame, value: Column, names: dict[str, float], key: str, n: int, date: str = "date", least: int | None = None, chunk: int = CHUNK, slot: int = SLOT) -> DataFrame:
    """df with a column for each quantile of the last n rows of a key up to the row; null with fewer than `least` (n) values among them.

    Null, NaN and infinite values are rows of the window without a value. Rows without a date come first; dates of a key are distinct, null keys
    are one key, an empty table stays empty, and columns of these names are replaced."""
    if not 0 < n <= chunk:
        raise ValueError(f"a window of 1 to {chunk} rows")
    columns = [c for c in df.columns if c not in names]
    rows = df.withColumn("_value", W.clean(value)).select(*columns, "_value")
    rows = rows.withColumn("_slot", F.coalesce(F.floor(F.unix_date(F.col(date).cast("date")) / slot).cast("long"), F.lit(-(1 << 40))))
    before = F.sum("_rows").over(W.over(["_key"], "_at").rowsBetween(Window.unboundedPreceding, -1))
    slots = rows.groupBy(F.col(key).alias("_key"), F.col("_slot").alias("_at")).agg(F.count("*").alias("_rows")).select("_key", "_at", F.coalesce(before, F.lit(0)).alias("_start"))
    rows = rows.withColumn("_n", F.row_number().over(W.over([key, "_slot"], date)) - 1)
    rows = rows.join(slots, rows[key].eqNullSafe(F.col("_key")) & (F.col("_slot") == F.col("_at"))).withColumn("_n", F.col("_start") + F.col("_n"))
    number = F.floor(F.col("_n") / chunk).cast("long")
    ahead = F.when(F.col("_n") % chunk > chunk - n, F.array(number, number + 1)).otherwise(F.array(number))  # the last ones also lead the next chunk
    dealt = rows.select(*columns, "_value", "_n", F.explode(ahead).alias("_chunk"))
    schema = T.StructType([*df.select(*columns).schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]])
    enough = n if least is None else least

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by("_n")
        found = window_quantiles(table["_value"].to_numpy(), n, list(names.values()), enough)
        own = pa.array(table["_n"].to_numpy() // chunk == table["_chunk"][0].as_py())
        return pa.table([*(table[c] for c in columns), *(pa.array(x, from_pandas=True) for x in found)], [*columns, *names]).filter(own)

    return dealt.groupBy(key, "_chunk").applyInArrow(work, schema)
