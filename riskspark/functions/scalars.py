"""Scalar expressions: text, identifiers, hashes, dates and constants."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quantiles of the normal distribution at 5 and 1 percent.
Z_05, Z_01 = -1.6448536269514722, -2.3263478740408408


def density(z: float) -> float:
    """Density of the normal distribution."""
    return math.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def densities(z: Column) -> Column:
    """Density of the normal distribution at each value of a column."""
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi)


def tidy(x: Column) -> Column:
    """Trimmed, in upper case, null if empty."""
    x = F.upper(F.trim(x))
    return F.when(x != "", x)


def spaced(x: Column) -> Column:
    """A name from an address: hyphens as blanks."""
    return F.regexp_replace(x, "-", " ")


def symbol(x: Column) -> Column:
    """A futures symbol without its suffix."""
    return F.regexp_replace(x, "=F$", "")


def first_word(x: Column) -> Column:
    return F.split(x, " ")[0]


def joined_id(*parts: Column) -> Column:
    """Parts joined by underscores; null parts are left out."""
    return F.concat_ws("_", *parts)


def day_text(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd")


def once(x: Column, make: Callable[[Column], Column]) -> Column:
    """make of a value that is worked out once, however often make names it. A name in a chain of columns does not do that where a filter stands on the
    chain: the filter is moved below it, with every name replaced by its expression."""
    return F.transform(F.array(x), make)[0]


def stable_hash(key: Column, m: int) -> Column:
    """SHA-256 of the key as an integer, modulo m (below 2**31). The digest is folded in five parts of 15 hexadecimal digits at most, so no value overflows."""

    def fold(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for at in range(0, 64, 15):
            digits = min(15, 64 - at)
            part = F.conv(F.substring(digest, at + 1, digits), 16, 10).cast("long")
            out = (out * ((1 << 4 * digits) % m) + part) % m
        return out

    return once(F.sha2(key, 256), fold)


def pick(options: Sequence, at: Column) -> Column:
    """The option at a zero-based place."""
    return F.element_at(F.array(*map(F.lit, options)), (at + 1).cast("int"))


def ladder(x: Column, steps: Sequence[tuple[str, float]]) -> Column:
    """The first option whose upper edge is above x; the last one beyond all."""

    def climb(x: Column) -> Column:
        out = F.when(x < steps[0][1], steps[0][0])
        for name, edge in steps[1:]:
            out = out.when(x < edge, name)
        return out.otherwise(steps[-1][0])

    return once(x, climb)


def bins(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Labels of right-closed bins; there is one label more than edges."""
    out = F.when(x.isNull(), None)
    for edge, name in zip(edges, labels, strict=False):
        out = out.when(x <= edge, name)
    return out.otherwise(labels[-1])


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """x held between bounds; null stays null."""
    y = x
    if low is not None:
        y = F.greatest(y, F.lit(float(low)))
    if high is not None:
        y = F.least(y, F.lit(float(high)))
    return F.when(x.isNotNull(), y)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def minute(ts: Column) -> Column:
    """Whole minutes since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / 60_000_000).cast("long")


def eastern(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "America/New_York")


def month_key(d: Column) -> Column:
    return F.date_format(d, "MM-yy")


def any_timestamp(text: Column) -> Column:
    """ISO text, epoch nanoseconds, or day-first text; null if it is none of them."""
    nanos = F.when(text.rlike(r"^\d{16,19}$"), F.timestamp_micros((text.try_cast("long") / 1000).cast("long")))
    return F.coalesce(nanos, F.try_to_timestamp(F.when(~text.rlike(r"^\d+$"), text)), F.try_to_timestamp(text, F.lit("dd-MM-yyyy")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


def years_later(d: Column, years: Column) -> Column:
    """d and years of 365 days, rounded to a whole day."""
    return F.date_add(d, F.bround(years * 365, 0).cast("int"))


def months_between(later: Column, earlier: Column) -> Column:
    """Days over 30, not below zero."""
    return F.greatest(F.lit(0.0), F.datediff(later, earlier) / 30.0)
