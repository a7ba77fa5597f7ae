"""Loans by month: panel, features and credit risk; and monthly macro series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.functions import scalars as S
from riskspark.functions import windows as W
from riskspark.operators.aggregates import month_end, standard_scores
from riskspark.operators.joins import active_months

LGD = 0.45
#: Rows of a rolling deviation of a loan, and values that it needs at least.
ROLL, LEAST = 3, 2


def monthly(df: DataFrame, key: str, aggregates: dict[str, Column], date: str = "date") -> DataFrame:
    """Aggregates of a key by month."""
    return df.groupBy(key, F.trunc(date, "month").alias("month")).agg(*[v.alias(k) for k, v in aggregates.items()])


def rolled_months(monthly: DataFrame, key: str, rolled: dict[str, str]) -> DataFrame:
    """monthly, one row a key and month, with deviations of the columns in rolled over the last 2 to ROLL months as name_2 to name_ROLL, also in the months after
    a row that have none.

    A loan has a row for each month of its life, so its last n rows are the last n months, and what rolls over them is its key's: worked out here once for all loans
    of a key, instead of in a window over each loan's rows."""
    values = [c for c in monthly.columns if c not in (key, "month")]
    moved = monthly.withColumn("_back", F.explode(F.array(*map(F.lit, range(ROLL))))).withColumn("month", F.add_months("month", F.col("_back")))
    within = lambda c, n: F.when(F.col("_back") < n, F.col(c))
    deviations = {f"{name}_{n}": F.when(F.count(within(c, n)) >= LEAST, F.stddev_samp(within(c, n))) for c, name in rolled.items() for n in range(2, ROLL + 1)}
    return moved.groupBy(key, "month").agg(*[F.max(within(c, 1)).alias(c) for c in values], *[v.alias(k) for k, v in deviations.items()])


def rolled_value(name: str, number: str) -> Column:
    """The deviation of a loan's last ROLL rows, or of those it has, from the columns of rolled_months(). number: of the month in its life, from 0."""
    return reduce(lambda out, n: out.when(F.col(number) == n - 1, F.col(f"{name}_{n}")), range(2, ROLL), F.when(F.col(number) >= ROLL - 1, F.col(f"{name}_{ROLL}")))


def loan_month_panel(loans: DataFrame, monthlies: list[tuple[DataFrame, str]], first: str | None = None, last: str | None = None, number: str | None = None) -> DataFrame:
    """A row for each month in which a loan is active, with monthly aggregates joined on (key, month). number: a column for the month's place in the panel, from 0."""
    spine = active_months(loans, "issue_date", "maturity_date", first, last, number).withColumn("date", F.col("month"))
    return reduce(lambda df, m: df.join(m[0], [m[1], "month"], "left"), monthlies, spine)


def loan_features(df: DataFrame, rolled: dict[str, str], number: str | None = None) -> DataFrame:
    """Rates, ages, income, collateralised share, and an index of standardised rolling deviations of the columns in rolled.

    They roll in a window over a loan's rows; number (a column of the panel): they are taken from columns of rolled_months(), and no row is moved."""
    df = df.withColumns({
        "spread_rate": F.col("spread_bps") / 10_000,
        "loan_age_months": S.months_between(F.col("date"), F.col("issue_date")),
        "time_to_maturity_months": S.months_between(F.col("maturity_date"), F.col("date")),
    })
    df = df.withColumn("interest_rate_monthly", (F.col("coupon_rate") + F.col("spread_rate")) / 12)
    df = df.withColumn("interest_income", F.col("notional_usd") * F.col("interest_rate_monthly"))
    if {"collateral_value", "exposure_before_collateral"} <= set(df.columns):
        df = df.withColumn("exposure_pct_collateralized", F.coalesce(W.ratio(F.col("collateral_value"), F.col("exposure_before_collateral")), F.lit(0.0)))
    w = W.over(["loan_id"], "date")
    parts = {f"_rolled_{name}": name for name in rolled.values()}
    df = df.withColumns({f"_rolled_{name}": rolled_value(name, number) if number else W.deviation(F.col(source), w, ROLL, LEAST) for source, name in rolled.items()})
    df = standard_scores(df, parts, population=True).drop(*parts)
    values = F.array_compact(F.array(*rolled.values()))
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.nullif(F.size(values), F.lit(0))
    return df.withColumn("volatility_index", mean)


def loan_credit_risk(df: DataFrame) -> DataFrame:
    """Default probability, loss, carry, spread profit, return on risk, and impairment stage."""
    said, had = F.col("pred_credit_spread"), F.col("credit_spread")
    df = df.withColumns({
        "loan_age_months": F.coalesce("loan_age_months", F.lit(0.0)),
        "time_to_maturity_months": F.coalesce("time_to_maturity_months", F.lit(0.0)),
        "PD": S.clip(said / 10, 0.01, 0.25),
        "LGD": F.lit(LGD),
        "EAD": F.col("notional_usd"),
        "carry_pnl_current": F.col("coupon_rate") * F.col("notional_usd") / 12,
        "spread_pnl": (said - had) * F.col("notional_usd") / 10_000,
        "stage": F.when(F.when(had > 0, said / had).otherwise(1.0) > 1.5, 2).otherwise(1),
    })
    df = df.withColumns({
        "expected_loss": F.col("PD") * F.col("LGD") * F.col("EAD"),
        "carry_pnl_cumulative": F.col("carry_pnl_current") * F.col("loan_age_months"),
        "total_pnl": F.col("carry_pnl_current") + F.col("spread_pnl"),
    })
    return df.withColumn("RAROC", F.when(F.col("expected_loss") > 0, F.col("total_pnl") / F.col("expected_loss")))


def macro_monthly(series: dict[str, DataFrame], months: DataFrame, date: str = "date", value: str = "value") -> DataFrame:
    """Month-end values of several series on one calendar of months, filled forward and backward."""
    out = months
    for name, df in series.items():
        out = out.join(month_end(df.withColumnRenamed(value, name), date, name, months), "month")
    return out
