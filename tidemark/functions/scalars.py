"""Normalisation and guarded arithmetic as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument

#: Form of an ISIN (fixed value).
ISIN = "^[A-Z]{2}[A-Z0-9]{9}[0-9]$"


def check_range(start: str | None, end: str | None) -> None:
    """A range of days or times, written alike, doesn't begin after its end."""
    if start is not None and end is not None and start > end:
        raise InvalidArgument(f"the range begins at {start}, after its end {end}")


def upper_code(c: Column) -> Column:
    return F.upper(F.trim(c))


def lower_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def is_isin(c: Column) -> Column:
    return upper_code(c).rlike(ISIN)


def market_date(ts: Column, zone: str | None = None) -> Column:
    """The date a timestamp shows; with ``zone``, the date there of that UTC instant."""
    return F.to_date(F.from_utc_timestamp(ts, zone) if zone else ts)


def utc_timestamp(text: Column) -> Column:
    """The UTC instant of a time stamp in text: by its offset or zone if it says one, otherwise it is taken to be in UTC, whatever the session's zone. What is no time stamp is null."""
    zoned = text.rlike(r"[T ]\d.*(Z|UTC|[+-]\d{1,2}:?(\d{2})?|[A-Za-z]+/[A-Za-z_]+)$")
    plain = F.concat(F.trim(text), F.when(text.contains(":"), "Z").otherwise(" 00:00:00Z"))
    return F.when(text.rlike(r"^\s*\d{4}-\d"), F.try_to_timestamp(F.when(zoned, text).otherwise(plain)))  # a time alone would be of today


def is_weekend(d: Column) -> Column:
    return F.weekday(d) >= 5


def is_finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    """a / b; null unless b is positive."""
    return F.when(b > 0, a / b)


def to_float64(c: Column) -> Column:
    """A decimal as double; null if it overflows, underflows to zero, or is null."""
    x = c.cast("double")
    return F.when(is_finite(x) & ~((x == 0) & (c != 0)), x)


def strict_float64(c: Column, name: str) -> Column:
    """A number as double for a model: null, what isn't finite, and what over- or underflows as a double raise."""
    message = F.concat(F.lit(f"{name} has no value as a double: "), F.coalesce(c.cast("string"), F.lit("null")))
    x = to_float64(c)
    return F.when(x.isNull(), F.raise_error(message).cast("double")).otherwise(x)


def tidy(c: Column, digits: int = 6) -> Column:
    """Rounded, without negative zero: equal across engines whose sums differ in the last bits."""
    return F.round(c, digits) + F.lit(0.0)
