"""Queries that see all bars, and arrays of any length."""

from riskspark.plans import fixtures, q_more, registry

SF = "/root/testdata/sf0.001"


def test_steps_of_long_arrays(spark):
    df = spark.createDataFrame([(0, [float(k % 2) for k in range(10_002)]), (1, [5.0])], "k int, c array<double>")
    assert {r["k"]: r["steps"] for r in df.select("k", q_more._steps("c").alias("steps")).collect()} == {0: 10_001.0, 1: None}


def test_all_bars_are_seen(spark):
    bars = fixtures.bars_daily(spark, SF)
    found = registry.queries()["F14_arrays_all_days"](spark, SF)
    assert found.count() == bars.select("ticker").distinct().count()
    years = lambda df: {r[0] for r in df.selectExpr("year(date)").distinct().collect()}
    assert years(registry.queries()["P07_trading_days_all_years"](spark, SF)) == years(bars) and len(years(bars)) > 1
