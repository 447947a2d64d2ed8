"""Labels: returns over the next bars of an instrument, by number of bars."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions.features import positive
from tidemark.functions.scalars import ratio
from tidemark.functions.windows import AGAIN, DATE, ID, along, no_repeats, order_column, repeats, series
from tidemark.operators.blocks import BLOCK, OWN, deal
from tidemark.operators.adjust import dividends_by_date, events_of, product, splits_of, within

TARGETS = ("forward_return", "total_return")


@dataclass(frozen=True)
class Target:
    """A label over ``horizon`` bars; with ``column`` one of the user's own, which makes a Column over the shared window from the horizon."""

    kind: str
    horizon: int
    column: Callable[[int], Column] | None = None

    def __post_init__(self) -> None:
        if (self.kind in TARGETS) == (self.column is not None):
            raise InvalidArgument(f"unknown target {self.kind!r}" if self.column is None else f"{self.kind!r} has a rule of its own")
        positive({"horizon": self.horizon}, "horizon", 1)


def ahead(horizon: int, column: Callable[[int], Column] | None = None) -> dict[str, Column]:
    """The bar at the end of the horizon, from the window that features share, and what the user's label is there."""
    w = series()
    own = {} if column is None else {"_own_label": column(horizon)}
    return {"_close_h": F.lead("close", horizon).over(w), "realization_date": F.lead(order_column(), horizon).over(w)} | own


def label(rows: DataFrame, target: Target, bars: DataFrame, actions: DataFrame | None = None, order: str = DATE) -> DataFrame:
    """``rows`` (with the columns of ``ahead``) with ``target``; null where it can't be computed.

    Corporate actions have dates. Of bars within days the last of an ex-date is the one that its dividend is held against, and what
    lies between two bars is told by their dates.
    """
    if target.column is not None:  # as all labels, only where the horizon has its bars
        return rows.withColumn("target", F.when(F.col("realization_date").isNotNull(), F.col("_own_label").cast("double"))).drop("_close_h", "_own_label")
    forward = ratio(F.col("_close_h"), F.col("close")) - 1
    if target.kind == "forward_return":
        return rows.withColumn("target", forward).drop("_close_h")
    if actions is None:
        raise InvalidArgument("total_return needs corporate actions")
    # Dividends are summed by ex-date and meet the bar of that day first; without one they have no price, and the label is null.
    if isinstance(bars.schema[order].dataType, T.DateType):
        closes = bars.select(ID, F.col(order).alias("ex_date"), F.col("close").alias("ex_close"))
    else:
        closes = bars.groupBy(ID, F.to_date(order).alias("ex_date")).agg(F.max_by("close", order).alias("ex_close"))
    priced = dividends_by_date(actions).join(closes, [ID, "ex_date"], "left")
    grown = priced.select(ID, "ex_date", F.when(F.col("ex_close") > 0, 1 + F.col("dividend") / F.col("ex_close")).alias("grown"))
    events = events_of(splits_of(actions), "ratio", "_splits").join(events_of(grown, "grown", "_paid"), ID, "full_outer")
    out = rows.join(events, ID, "left")
    day, until = F.to_date(order), F.to_date("realization_date")
    split = product(within(F.col("_splits"), day, until))
    paid = within(F.col("_paid"), day, until)
    known = ~F.coalesce(F.exists(paid, lambda e: e["x"].isNull()), F.lit(False))
    value = ratio(F.col("_close_h"), F.col("close") / split) * product(paid) - 1
    return out.withColumn("target", F.when(known, value)).drop("_close_h", "_splits", "_paid")


def add_target(bars: DataFrame, target: Target, actions: DataFrame | None = None, order: str = DATE, rows_per_block: int | None = None) -> DataFrame:
    """``bars`` with ``realization_date`` and ``target``. Two bars of one instrument with one date (or time) raise.

    With ``rows_per_block`` longer series are dealt to blocks, each with the bars of the horizon after it.
    """
    dealt = bars if rows_per_block is None else deal(bars, rows_per_block, 1, target.horizon, order)
    with along((ID,) if rows_per_block is None else (ID, BLOCK), order):
        rows = dealt.withColumns(ahead(target.horizon, target.column) | repeats()).where(no_repeats(order)).drop(AGAIN)
    if rows_per_block is not None:
        rows = rows.where(OWN).drop(OWN, BLOCK)
    return label(rows, target, bars, actions, order)
