"""Point lookups, range scans and point-in-time joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import check_range, lower_name, upper_code
from tidemark.functions.windows import DATE, ID


def _date(x: str) -> Column:
    return F.lit(x).cast("date")


def ascending(*columns: str) -> list[Column]:
    """An order by several columns; rows that lack one come last among their equals."""
    return [F.asc_nulls_last(c) for c in columns]


def bars_in_range(bars: DataFrame, instrument: int | str, start: str, end: str) -> DataFrame:
    check_range(start, end)
    return bars.where((F.col(ID) == instrument) & F.col(DATE).between(_date(start), _date(end))).orderBy(DATE)


def bar_at(bars: DataFrame, instrument: int | str, day: str) -> DataFrame:
    return bars.where((F.col(ID) == instrument) & (F.col(DATE) == _date(day)))


def latest_bars(bars: DataFrame) -> DataFrame:
    """The newest bar of each instrument: one hash aggregation with partial maxima, no sort. Dates of an instrument are unique."""
    cols = [c for c in bars.columns if c not in (ID, DATE)]
    return bars.groupBy(ID).agg(F.max(DATE).alias(DATE), *[F.max_by(c, DATE).alias(c) for c in cols]).select(*bars.columns)


def latest_bar(bars: DataFrame, instrument: int | str) -> DataFrame:
    return bars.where(F.col(ID) == instrument).orderBy(F.desc(DATE)).limit(1)


def by_id(rows: DataFrame, column: str, value: int | str) -> DataFrame:
    """One row of any table by its id; nothing if there is none."""
    return rows.where(F.col(column) == value)


def latest_bar_by_symbol(bars: DataFrame, instruments: DataFrame, exchanges: DataFrame, symbol: str, code: str) -> DataFrame:
    """The newest bar of a listing: the instrument is one row, so its bars are found by a broadcast."""
    one = instrument_by_symbol(instruments, exchanges, symbol, code).select(ID).limit(1)
    return latest_bars(bars.join(F.broadcast(one), ID, "left_semi"))


def by_code(exchanges: DataFrame, code: str) -> DataFrame:
    return exchanges.where(F.col("code") == upper_code(F.lit(code)))


def instruments_with_exchange(instruments: DataFrame, exchanges: DataFrame) -> DataFrame:
    """Exchanges are a small table; the optimizer broadcasts it when its size allows."""
    return instruments.join(exchanges.select("exchange_id", F.col("code").alias("exchange_code"), "country"), "exchange_id")


def instrument_by_symbol(instruments: DataFrame, exchanges: DataFrame, symbol: str, code: str) -> DataFrame:
    return instruments_with_exchange(instruments, exchanges).where(
        (F.col("symbol") == upper_code(F.lit(symbol))) & (F.col("exchange_code") == upper_code(F.lit(code)))
    )


def actions_of(actions: DataFrame, instrument: int | str, start: str | None = None, end: str | None = None, kind: str | None = None) -> DataFrame:
    check_range(start, end)
    found = F.col(ID) == instrument
    if start:
        found &= F.col("execution_date") >= _date(start)
    if end:
        found &= F.col("execution_date") <= _date(end)
    if kind:
        found &= F.col("action_type") == lower_name(F.lit(kind))
    return actions.where(found).orderBy(*ascending("execution_date", "action_type"))


def fundamentals_as_of(records: DataFrame, as_of: str, start: str | None = None, end: str | None = None, metric: str | None = None) -> DataFrame:
    """All records that were available at ``as_of``; those without availability never are."""
    check_range(start, end)
    seen = F.col("available_at").isNotNull() & (F.col("available_at") <= _date(as_of))
    if start:
        seen &= F.col("period_end") >= _date(start)
    if end:
        seen &= F.col("period_end") <= _date(end)
    if metric:
        seen &= F.col("metric_name") == lower_name(F.lit(metric))
    return records.where(seen).orderBy(*ascending("period_end", "metric_name", "available_at"))


def fundamentals_of(records: DataFrame, instrument: int | str, period: str, as_of: str | None = None) -> DataFrame:
    """One period's records of an instrument; with ``as_of`` only those that were available then."""
    seen = fundamentals_as_of(records, as_of) if as_of else records
    return seen.where((F.col(ID) == instrument) & (F.col("period_end") == _date(period))).orderBy(*ascending("metric_name"))


def as_of_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the newest row of ``right`` whose time is not after its own.

    Both sides go through one shuffle and sort; a window carries the last value on. Ties on the right: the greatest values.
    """
    kept = [c for c in left.columns if c not in by]
    a = left.select(*by, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*kept).alias("_left"), F.lit(None).alias("_right"))
    picked = F.struct(*values)
    b = right.where(F.col(right_time).isNotNull()).select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), picked.alias("_right"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b).withColumn("_last", F.last("_right", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*by, *[F.col(f"_left.{c}").alias(c) for c in kept], *[F.col(f"_last.{c}").alias(c) for c in values])


def symbols_as_of(dated: DataFrame, history: DataFrame, instruments: DataFrame) -> DataFrame:
    """``dated`` (instrument, date) with the symbol valid on the date, or else the current one.

    Intervals include both ends; of several the one that begins last counts. An instrument's few intervals are one array, joined
    once and searched in the row.
    """
    span = F.struct("effective_from", "effective_to", "symbol")
    spans = history.groupBy(ID).agg(F.collect_list(span).alias("_spans"))
    known = instruments.select(ID, F.col("symbol").alias("_now")).join(spans, ID, "full_outer")
    valid = lambda s: (s["effective_from"] <= F.col(DATE)) & (s["effective_to"].isNull() | (s["effective_to"] >= F.col(DATE)))
    found = F.array_max(F.transform(F.filter("_spans", valid), lambda s: F.struct(s["effective_from"], s["symbol"].alias("symbol"))))
    return dated.join(known, ID, "left").withColumn("symbol", F.coalesce(found["symbol"], "_now")).drop("_spans", "_now")


def newest(rows: DataFrame, by: list[str], time: str, tie: str, k: int = 1) -> DataFrame:
    """The k newest rows of each group, those without a time last; the optimizer keeps k rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(time), F.desc_nulls_last(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
