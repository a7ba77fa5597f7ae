"""Sliding quantiles against frames of rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from riskspark.functions import windows as W
from riskspark.operators import sliding


@pytest.mark.parametrize(("n", "least", "chunk", "slot"), [(5, None, 8, 7), (5, 2, 5, 30), (1, 1, 4, 1000), (60, None, 64, 11)])
def test_sliding_quantiles_equal_frames(spark, n, least, chunk, slot):
    r, day = random.Random(n), dt.date(2020, 1, 1)
    rows = [(k, day + dt.timedelta(3 * i), r.choice([None, 1.0, 2.0, r.gauss(0, 1)]), "x") for k in ("a", "b", None) for i in range(150 if k == "a" else 20)]
    df = spark.createDataFrame(rows, "key string, date date, value double, low string")
    got = sliding.rolling_quantiles(df, F.col("value"), {"low": 0.05, "mid": 0.5}, "key", n, least=least, chunk=chunk, slot=slot)
    w = W.over(["key"], "date")
    want = df.withColumns({"low": W.quantile(F.col("value"), w, n, 0.05, least), "mid": W.quantile(F.col("value"), w, n, 0.5, least)})
    told = lambda x: sorted(map(str, x.select("key", "date", "value", "low", "mid").collect()))
    assert told(got) == told(want) and got.count() == len(rows)


def test_sliding_quantiles_of_nothing_and_no_numbers(spark):
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1), float("nan")), ("a", None, float("inf")), ("a", dt.date(2020, 1, 2), 3.0)], "key string, date date, value double")
    got = sliding.rolling_quantiles(df, F.col("value"), {"q": 0.5}, "key", 3, least=1)
    assert sorted((str(x["date"]), x["q"]) for x in got.collect()) == [("2020-01-01", None), ("2020-01-02", 3.0), ("None", None)]
    assert sliding.rolling_quantiles(df.limit(0), F.col("value"), {"q": 0.5}, "key", 3).count() == 0
    with pytest.raises(ValueError):
        sliding.rolling_quantiles(df, F.col("value"), {"q": 0.5}, "key", 9, chunk=8)
