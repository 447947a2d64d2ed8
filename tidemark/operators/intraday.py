"""Bars within days: sessions of exchanges in their own time zones, market dates, and bars of any interval from ticks or shorter bars.

Time stamps are UTC instants. A session opens and closes at wall-clock times of its exchange, so what instants these are depends on daylight
saving; inside a session time is counted in elapsed seconds from its opening. A session whose close isn't after its open ends on the next day.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.windows import ID
from tidemark.operators.calendar import trades

TS = "ts"
_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400}


def interval_seconds(interval: str) -> int:
    """Length of an interval such as ``1m``, ``30m``, ``1h``; ``1d`` is a whole session."""
    m = re.fullmatch(r"([1-9]\d*)([smhd])", interval)
    if not m or m[2] == "d" and m[1] != "1":
        raise InvalidArgument(f"an interval is a number and s, m or h, or 1d, not {interval!r}")
    return int(m[1]) * _UNITS[m[2]]


def _clock(c: Column) -> Column:
    """Seconds of a time of day written HH:MM."""
    return F.split(c, ":")[0].cast("int") * 3600 + F.split(c, ":")[1].cast("int") * 60


def _instant(day: Column, seconds: Column, zone: Column) -> Column:
    """The UTC instant of a wall-clock time."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day).cast("long") * 86_400 + seconds), zone)


def in_sessions(rows: DataFrame, sessions: DataFrame, listing: str = "exchange_id", holidays: DataFrame | None = None, ts: str = TS) -> DataFrame:
    """``rows`` with ``market_date``, ``opens_at``, ``closes_at`` and ``in_session``.

    ``sessions``: one row for each exchange (``exchange_id``, ``timezone``, ``opens``, ``closes`` as HH:MM). The market date is the local date on which
    the session ends that is on, or that comes next after a close of its day. ``in_session``: from the opening until before the close,
    on days on which the exchange trades if ``holidays`` are given. Rows whose exchange has no session have nulls and aren't in one.
    The few sessions are left to the optimizer to broadcast; rows are not shuffled for them.
    """
    s = sessions.select(F.col("exchange_id").alias("_ex"), F.col("timezone").alias("_zone"), _clock(F.col("opens")).alias("_open"), _clock(F.col("closes")).alias("_close"))
    out = rows.join(s, F.col(listing) == F.col("_ex"), "left")
    local = F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.col("_zone"))
    second = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    over = F.col("_close") <= F.col("_open")  # night
    begun = F.when(over & (second < F.col("_close")), F.date_sub(F.to_date(local), 1)).otherwise(F.to_date(local))
    out = out.withColumn("_begun", begun).withColumn("market_date", F.when(over, F.date_add("_begun", 1)).otherwise(F.col("_begun")))
    out = out.withColumns({"opens_at": _instant(F.col("_begun"), F.col("_open"), F.col("_zone")), "closes_at": _instant(F.col("market_date"), F.col("_close"), F.col("_zone"))})
    on = (F.col(ts) >= F.col("opens_at")) & (F.col(ts) < F.col("closes_at"))
    if holidays is not None:
        h = holidays.select(F.col("exchange_id").alias("_hx"), F.col("holiday_date").alias("_hd"), F.col("session_type").alias("_kind"))
        out = out.join(h, (F.col("_hx") == F.col(listing)) & (F.col("_hd") == F.col("market_date")), "left")
        on &= trades(F.col("market_date"), F.col("_kind"))
    return out.withColumn("in_session", F.coalesce(on, F.lit(False))).drop("_ex", "_zone", "_open", "_close", "_begun", "_hx", "_hd", "_kind")


def ticks_as_bars(ticks: DataFrame, price: str, size: Column) -> DataFrame:
    """Each tick as a bar of one price."""
    return ticks.withColumns({c: F.col(price) for c in ("open", "high", "low", "close")} | {"volume": size.cast("double")})


def resample(bars: DataFrame, sessions: DataFrame, interval: str, listing: str = "exchange_id", holidays: DataFrame | None = None, ts: str = TS) -> DataFrame:
    """Bars of a longer interval: ``instrument_id``, ``ts`` (begin of the window), ``market_date``, OHLC, ``volume``.

    Windows tumble from each session's opening on, so the last of a session may be shorter; ``1d`` gives one bar a session. Bars out of sessions are left out.
    One hash aggregation with partial results; time stamps of an instrument are unique.
    """
    seconds = interval_seconds(interval)
    inside = in_sessions(bars, sessions, listing, holidays, ts).where("in_session")
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    opened = F.unix_micros("opens_at")
    length = seconds * 1_000_000
    begin = F.col("opens_at") if interval == "1d" else F.timestamp_micros(opened + F.floor((at - opened) / length) * length)
    rows = inside.withColumns({"_begin": begin, "_at": at})
    return rows.groupBy(ID, F.col("_begin").alias(ts), "market_date").agg(
        F.min_by("open", "_at").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "_at").alias("close"),
        F.sum("volume").alias("volume"),
    )
