"""Tables that are changed part by part.

Rows are dealt into parts by an expression (a date, a month, a bucket of keys). The table is a manifest: for each part the folder that holds it now. A
change reads and writes only the parts that it touches, into folders of its own, and then a new manifest takes the place of the old one, so a
change that breaks off leaves the table as it was, and readers of the old manifest keep what they read. A change that began on a manifest that is no longer
the current one is refused. vacuum() removes what the last few manifests do not name.

On the driver are the names of parts and of their folders, never rows."""

from __future__ import annotations

import calendar
import json
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskspark.operators.quality import QualityError
from riskspark.operators.tables import duplicate_keys

#: The column that tells parts within a table's folders.
PART = "_part"


def monthly(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def daily(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def bucket(key: str, buckets: int = 64) -> Column:
    return F.lpad(F.pmod(F.xxhash64(key), F.lit(buckets)).cast("string"), 6, "0")


class Partitioned:
    """A table under one folder. part: a string for each row, by which rows are dealt; for changes of date ranges it has to rise with the date."""

    def __init__(self, spark: SparkSession, path: str, part: Column, date: str = "date"):
        self.spark, self.path, self.part, self.date = spark, path, part, date
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def sequence(self) -> int:
        """The number of the current manifest; 0 before the first."""
        return max((int(n) for n in self._names("manifests") if n.isdigit()), default=0)

    def manifest(self, sequence: int | None = None) -> tuple[dict[str, str], str | None]:
        """Folder of each part, and the schema of the rows."""
        sequence = self.sequence() if sequence is None else sequence
        if not sequence:
            return {}, None
        rows = self.spark.read.schema("part string, folder string, schema string").parquet(f"{self.path}/manifests/{sequence}").collect()
        return {r["part"]: r["folder"] for r in rows if r["part"] is not None}, next(r["schema"] for r in rows if r["schema"] is not None)

    def _rows(self, folders: Iterable[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/data/{f}" for f in folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, parts: Iterable[str] | None = None) -> DataFrame | None:
        """All rows, or those of some parts; None before the first write."""
        folders, schema = self.manifest()
        if schema is None:
            return None
        return self._rows((folders[p] for p in (folders if parts is None else parts) if p in folders), T.StructType.fromJson(_json(schema)))

    def change(self, touched: Iterable[str], build: Callable[[DataFrame | None], DataFrame | None]) -> dict[str, str]:
        """Put what build makes of the rows of the touched parts in their place; a touched part without rows goes. build(None): there is no table yet.

        Returns the folders written."""
        base = self.sequence()
        folders, schema = self.manifest(base)
        touched = set(touched)
        old = None if schema is None else self._rows((folders[p] for p in sorted(touched & folders.keys())), T.StructType.fromJson(_json(schema)))
        new, version, fresh = build(old), uuid.uuid4().hex, {}
        if new is not None:
            schema = _with(schema, new.schema)
            dealt = new.withColumn(PART, self.part)
            dealt.repartition(PART, F.pmod(F.xxhash64(*[c for c, t in new.dtypes if not t.startswith("map")]), F.lit(8))).write.partitionBy(PART).parquet(f"{self.path}/data/{version}")
            fresh = {unquote(n.split("=", 1)[1]): f"{version}/{n}" for n in self._names(f"data/{version}") if n.startswith(f"{PART}=")}
        kept = {p: f for p, f in folders.items() if p not in touched}
        if both := kept.keys() & fresh.keys():
            raise QualityError(f"rows of parts that the change does not touch: {', '.join(sorted(both)[:5])}")
        self._commit(base, kept | fresh, schema)
        return fresh

    def _commit(self, base: int, folders: dict[str, str], schema: str | None) -> None:
        made, to = self._hadoop(f"{self.path}/manifests/_{uuid.uuid4().hex}"), self._hadoop(f"{self.path}/manifests/{base + 1}")
        rows = [(p, f, None) for p, f in folders.items()] + [(None, None, schema)]
        self.spark.createDataFrame(rows, "part string, folder string, schema string").coalesce(1).write.parquet(made.toString())
        if self._fs.exists(to) or not self._fs.rename(made, to):
            self._fs.delete(made, True)
            raise QualityError("another change came first; this one began on a table that is no longer current")

    def parts_of(self, df: DataFrame) -> list[str]:
        return [r[0] for r in df.select(self.part.alias("p")).distinct().collect()]

    def _between(self, start: str | None, end: str | None) -> list[str]:
        """Parts of the table from a date to a date."""
        ask = lambda d: self.spark.range(1).select(F.lit(d).cast("date").alias(self.date)).select(self.part).first()[0]
        low, high = ask(start) if start else None, ask(end) if end else None
        return [p for p in self.manifest()[0] if (low is None or p >= low) and (high is None or p <= high)]

    def append(self, new: DataFrame) -> dict[str, str]:
        """More rows; the parts they fall into are written again."""
        return self.change(self.parts_of(new), lambda old: new if old is None else old.unionByName(new, allowMissingColumns=True))

    def merge(self, new: DataFrame, keys: list[str], moves: bool = False) -> dict[str, str]:
        """Upsert by key; raises if the new rows repeat one. moves: a key's part may have changed, so the parts of its old rows are looked for."""
        if not duplicate_keys(new, keys).isEmpty():
            raise QualityError(f"repeated keys ({', '.join(keys)}) in the rows to merge")
        touched = set(self.parts_of(new))
        if moves and (old := self.read()) is not None:
            touched |= set(self.parts_of(old.join(new.select(*keys), keys, "left_semi")))
        return self.change(touched, lambda old: new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))

    def replace_dates(self, new: DataFrame, start: str | None = None, end: str | None = None) -> dict[str, str]:
        """The rows from a date to a date (both included) replaced, also those of dates that the new rows lack; rows without a date stay."""
        inside = F.lit(True)
        for bound, within in ((start, lambda d: F.col(self.date) >= d), (end, lambda d: F.col(self.date) <= d)):
            inside = inside if bound is None else inside & within(F.lit(bound).cast("date"))
        stay = ~F.coalesce(inside & F.col(self.date).isNotNull(), F.lit(False))
        return self.change({*self._between(start, end), *self.parts_of(new)}, lambda old: new if old is None else old.where(stay).unionByName(new, allowMissingColumns=True))

    def replace_months(self, new: DataFrame) -> dict[str, str]:
        """The months of the new rows replaced."""
        month = F.trunc(self.date, "month")
        months = new.select(month.alias("_m")).distinct()
        first = [r["_m"] for r in months.where("_m is not null").collect()]  # months, not rows
        touched = {p for m in first for p in self._between(str(m), str(_last_day(m)))} | set(self.parts_of(new))
        return self.change(touched, lambda old: new if old is None else old.join(F.broadcast(months), month == F.col("_m"), "left_anti").unionByName(new, allowMissingColumns=True))

    def keep_dates(self, days: int) -> dict[str, str]:
        """Only the last so many distinct dates stay: older parts leave the manifest, and the part of the oldest date is written again."""
        dates = self.read().select(self.date).distinct().orderBy(F.desc_nulls_last(self.date)).limit(days)
        least = dates.agg(F.min(self.date)).first()[0]
        if least is None:
            return {}
        edge = self._between(str(least), str(least))
        older = [p for p in self._between(None, str(least)) if p not in edge]
        return self.change([*older, *edge], lambda old: old.where(F.col(self.date) >= F.lit(least)))

    def roll(self, new: DataFrame, keys: list[str], days: int) -> dict[str, str]:
        """Rolling layer: upsert by keys, which hold the date, then the last so many dates."""
        return self.merge(new, keys) | self.keep_dates(days)

    def serve(self, new: DataFrame, keep: int = 2) -> dict[str, str]:
        """Serving table: dates of the new rows replaced, then the last dates."""
        dates = new.select(self.date).distinct()
        done = self.change(self.parts_of(new), lambda old: new if old is None else old.join(F.broadcast(dates), self.date, "left_anti").unionByName(new, allowMissingColumns=True))
        return done | self.keep_dates(keep)

    def clean_write(self, new: DataFrame, mode: str, keys: list[str], start: str | None = None, end: str | None = None) -> dict[str, str]:
        """Backfills replace their window; other modes merge."""
        return self.replace_dates(new, start, end) if mode == "backfill" else self.merge(new, keys)

    def vacuum(self, manifests: int = 5) -> list[str]:
        """Remove older manifests than the last few, and folders that none of these names, also those of changes that broke off. Not to be run beside changes."""
        numbers = sorted((int(n) for n in self._names("manifests") if n.isdigit()), reverse=True)
        kept = numbers[:manifests]
        named = {f for n in kept for f in self.manifest(n)[0].values()}
        gone = []
        for version in self._names("data"):
            parts = [f"{version}/{n}" for n in self._names(f"data/{version}") if n.startswith(f"{PART}=")]
            dead = [p for p in parts if p not in named]
            gone += [f"data/{version}"] if len(dead) == len(parts) else [f"data/{p}" for p in dead]
        gone += [f"manifests/{n}" for n in self._names("manifests") if not (n.isdigit() and int(n) in kept)]
        for folder in gone:
            self._fs.delete(self._hadoop(f"{self.path}/{folder}"), True)
        return gone


def _json(schema: str) -> dict:
    return json.loads(schema)


def _with(schema: str | None, more: T.StructType) -> str:
    """The schema of a table that takes rows with perhaps other columns."""
    own = [] if schema is None else list(T.StructType.fromJson(_json(schema)).fields)
    known = {f.name for f in own}
    return T.StructType([T.StructField(f.name, f.dataType) for f in own + [f for f in more.fields if f.name not in known]]).json()


def _last_day(day):
    return day.replace(day=calendar.monthrange(day.year, day.month)[1])
