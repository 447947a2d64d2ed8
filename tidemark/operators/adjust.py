"""Split factors and split-adjusted bars.

An instrument has few corporate actions, so they become one sorted array for each instrument. Bars meet them in one join by
instrument, and what lies after (or within a span of) a bar's date is folded in the row: nothing is shuffled by date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.windows import DATE, ID

BAR_KEY = [ID, DATE]


def splits_of(actions: DataFrame) -> DataFrame:
    """Splits with usable ratios; a ratio that is not positive is an error in the data and raises."""
    ratio = F.when(F.col("value") > 0, F.col("value")).otherwise(F.raise_error(F.lit("split ratio must be positive")).cast("double"))
    return actions.where(F.col("action_type") == "split").select(ID, F.col("execution_date").alias("ex_date"), ratio.alias("ratio"))


def events_of(dated: DataFrame, value: str, name: str) -> DataFrame:
    """``name``: the instrument's (``ex_date``, ``value``) pairs in order of date."""
    return dated.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("ex_date", F.col(value).cast("double").alias("x")))).alias(name))


def within(events: Column, after: Column, until: Column | None = None) -> Column:
    """Events after a date, and not after another."""
    return F.filter(events, lambda e: (e["ex_date"] > after) if until is None else (e["ex_date"] > after) & (e["ex_date"] <= until))


def product(events: Column) -> Column:
    """The product of the events' values; 1 if there are none."""
    return F.coalesce(F.aggregate(events, F.lit(1.0), lambda acc, e: acc * e["x"]), F.lit(1.0))


def _with_splits(bars: DataFrame, actions: DataFrame, as_of: str | None) -> DataFrame:
    s = splits_of(actions)
    if as_of:
        s = s.where(F.col("ex_date") <= F.lit(as_of).cast("date"))
    return bars.join(events_of(s, "ratio", "_splits"), ID, "left").withColumn("_splits", within(F.col("_splits"), F.col(DATE)))


def split_factors(bars: DataFrame, actions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Product of the ratios of all splits after each bar's date (and not after ``as_of``); bars without any are left out."""
    return _with_splits(bars.select(*BAR_KEY), actions, as_of).where(F.size("_splits") > 0).select(*BAR_KEY, product(F.col("_splits")).alias("factor"))


def adjust_bars(bars: DataFrame, actions: DataFrame, as_of: str | None = None) -> DataFrame:
    """Prices divided and volumes multiplied by the factor; bars on an ex-date are already adjusted for it."""
    out = _with_splits(bars, actions, as_of).withColumn("_factor", product(F.col("_splits")))
    f = F.col("_factor")
    return out.withColumns({c: F.col(c) / f for c in ("open", "high", "low", "close")} | {"volume": F.col("volume") * f}).select(*bars.columns)


def dividends_by_date(actions: DataFrame) -> DataFrame:
    d = actions.where(F.col("action_type") == "dividend")
    return d.groupBy(ID, F.col("execution_date").alias("ex_date")).agg(F.sum("value").alias("dividend"))
