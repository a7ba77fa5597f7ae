"""As-of joins by slots, staged tables, sketches, stored models and scans of a database."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from riskspark.operators import equity, intraday, joins, scoring, sketches, tables
from riskspark.plans import fixtures as X
from riskspark.plans.staged import Staged
from riskspark.sources import scans, warehouse

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def latest(events, key, at):
    """The value of the last event at or before a time, times that are null first."""
    order = lambda t: (t is not None, t)
    told = [(order(t), v) for k, t, v in events if k == key and v is not None and order(t) <= order(at)]
    return max(told)[1] if told else None


@pytest.mark.parametrize("slot", [1, 3, 1000])
def test_as_of_by_slots_is_the_last_event_before(spark, slot):
    rng = random.Random(slot)
    when = lambda: None if rng.random() < 0.05 else DAY + dt.timedelta(days=rng.randrange(60))
    key = lambda: rng.choice(["hot", "hot", "hot", "b", None])
    left = [(i, key(), when()) for i in range(300)]
    right = [(key(), when(), None if rng.random() < 0.2 else rng.randrange(9)) for _ in range(60)]
    a = spark.createDataFrame(left, "id int, k string, date date")
    b = spark.createDataFrame(right, "k string, date date, v int")
    got = {r.id: r.v for r in joins.as_of(a, b, "k", "date", "v", slot).collect()}
    assert got == {i: latest(right, k, at) for i, k, at in left}


def test_as_of_of_numbers_times_and_empty_sides(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 50)], "id int, k string, n long")
    right = spark.createDataFrame([("a", 7, 1.5)], "k string, n long, v double")
    with pytest.raises(ValueError, match="length of a slot"):
        joins.as_of(left, right, "k", "n", "v")
    assert {r.id: r.v for r in joins.as_of(left, right, "k", "n", "v", 10).collect()} == {1: None, 2: 1.5}
    assert {r.id: r.v for r in joins.as_of(left, right.limit(0), "k", "n", "v", 10).collect()} == {1: None, 2: None}
    at = left.withColumn("n", F.timestamp_seconds(F.col("n") * 86_400))
    assert {r.id: r.v for r in joins.as_of(at, right.withColumn("n", F.timestamp_seconds(F.col("n") * 86_400)), "k", "n", "v").collect()} == {1: None, 2: 1.5}


def test_staged_bars_are_read_without_a_shuffle_and_give_the_same_rates(spark):
    x = Staged().trading(spark, SF)
    ranked = x.bars_daily(spark, SF).groupBy("ticker").agg(F.max("close"))
    assert "Exchange hashpartitioning(ticker" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert x.positions(spark, SF) is x.positions(spark, SF)
    rates = {(r.currency_pair, r.date): r.fx_rate for r in x.fx_daily(spark, SF).collect()}
    assert rates == {(r.currency_pair, r.date): pytest.approx(r.fx_rate) for r in X.fx_daily(spark, SF).collect()}


def test_trades_deal_the_line_items_of_the_newest_bars_alone(spark):
    from riskspark.plans import market

    x = Staged()
    recent, bars = market._recent_bars(spark, SF, 2, x), {(r.ticker, r.date): r.close for r in X.bars_daily(spark, SF).collect()}
    assert not x.has_bars() and {(r.ticker, r.date) for r in x.ticker_days(spark, SF).collect()} == set(bars)
    got = {(r.ticker, r.date): r.close for r in recent.collect()}
    for ticker in {t for t, _ in bars}:
        newest = sorted((d for t, d in bars if t == ticker), reverse=True)[: 2 + equity.PAST]
        assert all(got[ticker, d] == bars[ticker, d] for d in newest)
    assert market.equity_since(spark, SF, 1, x).count() and "recent 1" not in x._made


def test_commodity_days_by_their_ends(spark):
    rows = lambda df: sorted(map(str, df.select("commodity", "date", "open", "high", "low", "close").collect()))
    assert rows(X.commodity_by_ends(spark, SF)) == rows(X.commodity_daily(spark, SF))


def test_bonds_of_one_small_file_are_many_tasks_work(spark):
    from riskspark.plans import market

    assert "RoundRobinPartitioning" in market.bond_table(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_sketches_roll_up_within_their_bounds(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("a"), (F.col("id") % 14).alias("b"), (F.col("id") % 20_000).alias("v"))
    fine = sketches.sketched(df, ["a", "b"], {"v": "d"}, {"v": "q"})
    for keys, groups in ((["a"], 7), ([], 1)):
        told = sketches.with_quantile(sketches.with_counts(sketches.rolled(fine, keys, ["d"], ["q"]), "d", "n"), "q", "m", 0.25).collect()
        assert len(told) == groups
        for r in told:
            exact = df.where(F.col("a") == r.a) if keys else df
            n, low, high = exact.agg(F.count_distinct("v"), F.percentile("v", 0.24), F.percentile("v", 0.26)).first()
            assert r.n_low <= n <= r.n_high and r.n_high - r.n_low < 0.11 * n
            assert r.m_low <= high and r.m_high >= low and r.m_low <= r.m <= r.m_high


def test_sketches_of_nothing(spark):
    df = spark.createDataFrame([("a", None)], "k string, v double")
    one = sketches.with_quantile(sketches.sketched(df, ["k"], quantiles={"v": "q"}), "q", "m", 0.5).first()
    assert one.m is None and one.m_low is None
    assert sketches.with_counts(sketches.sketched(df.withColumn("v", F.col("v").cast("long")), ["k"], {"v": "d"}), "d", "n").first().n == 0


def test_the_newest_stored_model_scores_and_failures_are_told(spark, tmp_path):
    folder = str(tmp_path / "models")
    for run, intercept in (("2024-01", 1.0), ("2024-02", 2.0)):
        scoring.store(spark, folder, run, ["x", "absent"], json.dumps({"intercept": intercept, "weights": {"x": 3.0}}).encode())
    df = spark.createDataFrame([(1, 2.0), (2, None)], "id int, x double")
    rows = lambda m: {r.id: (r.s, r.s_model, r.s_error) for r in scoring.scored_by(df, "s", m, scoring.linear_model).collect()}
    assert rows(scoring.stored(spark, folder)) == {1: (8.0, "2024-02", None), 2: (2.0, "2024-02", None)}
    assert rows(scoring.stored(spark, folder, "2024-01"))[1] == (7.0, "2024-01", None)
    scoring.store(spark, folder, "2024-03", ["x"], b"no model")
    broken = rows(scoring.stored(spark, folder))
    assert {v[:2] for v in broken.values()} == {(None, "2024-03")} and all("JSONDecodeError" in v[2] for v in broken.values())
    with pytest.raises(ValueError, match="missing features: absent"):
        scoring.scored_by(df, "s", scoring.stored(spark, folder, "2024-01"), scoring.linear_model, strict=True)
    with pytest.raises(ValueError, match="no numbers: x"):
        scoring.scored_by(df.withColumn("x", F.lit("a")), "s", scoring.stored(spark, folder), scoring.linear_model)
    with pytest.raises(ValueError, match="no model of run"):
        scoring.stored(spark, folder, "2023-01")


def test_database_scans_push_their_bounds(spark, tmp_path):
    spark._jvm.System.setProperty("derby.stream.error.file", str(tmp_path / "derby.log"))
    url, how = "jdbc:derby:memory:orders;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    orders = X.table(spark, SF, "orders").select(F.col("o_orderkey").alias("OID"), F.to_date("o_orderdate").alias("DAY"), F.col("o_totalprice").alias("PRICE"))
    orders.write.jdbc(url, "ORDERS", mode="overwrite", properties=how)
    read = warehouse.scan(spark, url, "ORDERS", "DAY", 4, how)
    assert read.rdd.getNumPartitions() == 4 and read.count() == orders.count()
    late = scans.from_month(read, "1998-03-01", "DAY").select("OID")
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(DAY,1998-03-01)" in plan and "PRICE" not in plan.split("ReadSchema")[1]
    same = lambda a, b: sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())
    assert same(late, scans.from_month(orders, "1998-03-01", "DAY").select("OID"))
    day = dt.date(1998, 1, 1)
    assert same(scans.after(read, day, "DAY").select("OID"), scans.after(orders, day, "DAY").select("OID"))
    orders.limit(0).write.jdbc(url, "EMPTY", mode="overwrite", properties=how)
    assert warehouse.scan(spark, url, "EMPTY", "DAY", 4, how).count() == 0


def test_a_buffer_longer_than_a_chunk_is_refused(spark):
    with pytest.raises(ValueError, match="buffer"):
        intraday.metrics(X.ticks(spark, SF), rows=intraday.CHUNK + 1)


def test_the_shared_folder_takes_staged_tables(spark):
    df = tables.staged(spark.range(10).withColumn("k", F.col("id") % 3), "k", "id")
    assert sorted(r.id for r in df.collect()) == list(range(10))
