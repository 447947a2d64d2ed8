"""The one window of a bar series: everything that looks along it shares a single shuffle and sort.

Families of features and labels ask ``series()`` for it. By default it is an instrument's bars by date; ``along`` gives it another order
column, or a part of a long series (``operators.blocks``), for all that is compiled inside.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

ID, DATE = "instrument_id", "date"
_ALONG: ContextVar[tuple[tuple[str, ...], str]] = ContextVar("along", default=((ID,), DATE))


@contextmanager
def along(keys: tuple[str, ...] = (ID,), order: str = DATE) -> Iterator[None]:
    """Windows that are compiled inside go by these columns."""
    token = _ALONG.set((keys, order))
    try:
        yield
    finally:
        _ALONG.reset(token)


def order_column() -> str:
    return _ALONG.get()[1]


def series(ident: str | None = None, order: str | None = None) -> WindowSpec:
    keys, by = _ALONG.get()
    return Window.partitionBy(*([ident] if ident else keys)).orderBy(order or by)


def last_rows(n: int, ident: str | None = None, order: str | None = None) -> WindowSpec:
    return series(ident, order).rowsBetween(-(n - 1), 0)


AGAIN = "_again"


def repeats() -> dict[str, Column]:
    """Whether a bar has the date (or time) of the one before it: it would count as a bar of every lookback and horizon."""
    at = F.col(order_column())
    return {AGAIN: F.coalesce(F.lag(at).over(series()) == at, F.lit(False))}


def no_repeats(at: str) -> Column:
    """True; raises where ``repeats`` holds. It belongs into a condition on all rows, since a column that is only selected is not computed for rows that are filtered out."""
    message = F.concat(F.lit("two bars of one instrument at "), F.col(at).cast("string"))
    return F.when(F.col(AGAIN), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
