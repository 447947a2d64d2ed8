"""Trading calendar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import check_range, is_weekend


def holidays_in_range(holidays: DataFrame, start: str, end: str, exchange: int | str | None = None) -> DataFrame:
    check_range(start, end)
    found = holidays.where(F.col("holiday_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return (found if exchange is None else found.where(F.col("exchange_id") == exchange)).orderBy("exchange_id", "holiday_date")


def holidays_of_year(holidays: DataFrame, exchange: int | str, year: int) -> DataFrame:
    return holidays_in_range(holidays, f"{year:04d}-01-01", f"{year:04d}-12-31", exchange)


def holiday_on(holidays: DataFrame, exchange: int | str, day: str) -> DataFrame:
    return holidays_in_range(holidays, day, day, exchange)


def trades(day: Column, session: Column) -> Column:
    """Weekends trade in half-day and early-close sessions only; weekdays unless it is a full-day holiday."""
    return F.when(is_weekend(day), F.coalesce(session.isin("half_day", "early_close"), F.lit(False))).otherwise(session.isNull() | (session != "full_day"))


def calendar(exchanges: DataFrame, holidays: DataFrame, start: str, end: str) -> DataFrame:
    """Every day of every exchange: ``is_holiday`` (of any session type) and ``is_trading_day``."""
    check_range(start, end)
    days = exchanges.select("exchange_id", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date"))
    h = holidays.select("exchange_id", F.col("holiday_date").alias("date"), "session_type")
    out = days.join(h, ["exchange_id", "date"], "left")
    return out.withColumns({"is_holiday": F.col("session_type").isNotNull(), "is_trading_day": trades(F.col("date"), F.col("session_type"))})


def trading_days(exchanges: DataFrame, holidays: DataFrame, start: str, end: str) -> DataFrame:
    return calendar(exchanges, holidays, start, end).where("is_trading_day").select("exchange_id", "date")
