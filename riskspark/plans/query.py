"""A registered query: its Spark form, its SQL, and the columns and digits that both return."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.plans import fixtures

ALL: dict[str, Query] = {}


#: Spare digits: a value is rounded to them first, so that the last bits, which depend on the order of a sum, do not decide what half a digit does.
SPARE = 3


def _floor(x: Column) -> Column:
    """Floor as a double. Spark's own is a BIGINT, which ends at 9.2e18; a double is whole from 2^53 on."""
    return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)


def _cut(x: Column, digits: int) -> Column:
    """Rounded half up."""
    near = _floor(x * float(f"1e{digits + SPARE}") + 0.5) / float(f"1e{SPARE}")
    return _floor(near + 0.5) / float(f"1e{digits}")


def _cut_sql(c: str, digits: str) -> str:
    return f"floor(floor(CAST({c} AS DOUBLE) * 1e{int(digits) + SPARE} + 0.5) / 1e{SPARE} + 0.5) / 1e{digits} AS {c}"


@dataclass(frozen=True)
class Query:
    """columns: names separated by blanks; name:n rounds a double to n digits."""

    name: str
    build: Callable[[SparkSession, str], DataFrame]
    columns: str
    sql: str | None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        picked = [c.split(":") for c in self.columns.split()]
        return self.build(spark, sf).select(*[_cut(F.col(c[0]).cast("double"), int(c[1])).alias(c[0]) if len(c) > 1 else F.col(c[0]) for c in picked])

    def text(self, ctes: dict[str, str]) -> str | None:
        if self.sql is None:
            return None
        need: set[str] = set()

        def add(body: str) -> None:
            for word in set(re.findall(r"\w+", body)) & ctes.keys() - need:
                need.add(word)
                add(ctes[word])

        add(self.sql)
        picked = [c.split(":") for c in self.columns.split()]
        columns = ", ".join(_cut_sql(*c) if len(c) > 1 else c[0] for c in picked)
        before = ", ".join(f"{k} AS ({v})" for k, v in ctes.items() if k in need)
        return (f"WITH RECURSIVE {before} " if before else "") + f"SELECT {columns} FROM ({self.sql}) AS result"


def query(name: str, columns: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) as a query."""

    def register(build):
        if name in ALL:
            raise ValueError(f"{name} is registered twice")
        ALL[name] = Query(name, build, columns, sql)
        return build

    return register


def fixture(name: str):
    """The fixture of that name as a function of (spark, sf_dir)."""
    return getattr(fixtures, name)
