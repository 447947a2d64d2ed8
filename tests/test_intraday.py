"""Sessions and bars within days, by zone and over daylight saving."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from tidemark.errors import InvalidArgument
from tidemark.functions.features import Feature
from tidemark.operators import intraday
from tidemark.operators.targets import Target
from tidemark.plans import dataset

SESSIONS = [(1, "America/New_York", "09:30", "16:00"), (2, "Asia/Kolkata", "09:15", "15:30"), (3, "America/Chicago", "17:00", "16:00"), (4, "Europe/Berlin", "22:00", "06:00")]
BARS = "instrument_id long, exchange_id long, ts timestamp, open double, high double, low double, close double, volume double"


@pytest.fixture(scope="module")
def sessions(spark):
    return spark.createDataFrame(SESSIONS, "exchange_id long, timezone string, opens string, closes string")


def plain(ex, at):
    """Market date, opening, close and whether it is open, by the zone database."""
    _, zone, opens, closes = SESSIONS[ex - 1]
    zone, (oh, om), (ch, cm) = ZoneInfo(zone), map(int, opens.split(":")), map(int, closes.split(":"))
    local = at.astimezone(zone)
    night = (ch, cm) <= (oh, om)
    begun = local.date() - dt.timedelta(days=1) if night and (local.hour, local.minute) < (ch, cm) else local.date()
    ends = begun + dt.timedelta(days=night)
    a, b = (dt.datetime(d.year, d.month, d.day, h, m, tzinfo=zone).astimezone(dt.UTC) for d, h, m in ((begun, oh, om), (ends, ch, cm)))
    return ends, a, b, a <= at < b


def instants():
    """Around the changes of clocks of spring and autumn, and new year."""
    days = [(2024, 3, 8), (2024, 3, 10), (2024, 3, 11), (2024, 3, 30), (2024, 3, 31), (2024, 10, 26), (2024, 10, 27), (2024, 11, 3), (2024, 11, 4), (2023, 12, 31)]
    return [dt.datetime(*d, tzinfo=dt.UTC) + dt.timedelta(minutes=37 * i, seconds=i) for d in days for i in range(40)]


def test_sessions(spark, sessions):
    rows = [(i, ex, at, 1.0, 1.0, 1.0, 1.0, 1.0) for ex in (1, 2, 3, 4) for i, at in enumerate(instants())] + [(0, 9, instants()[0], 1.0, 1.0, 1.0, 1.0, 1.0), (0, None, instants()[0], 1.0, 1.0, 1.0, 1.0, 1.0)]
    utc = lambda t: t and t.astimezone(dt.UTC)
    got = intraday.in_sessions(spark.createDataFrame(rows, BARS), sessions).selectExpr("exchange_id", "unix_micros(ts)", "market_date", "unix_micros(opens_at)", "unix_micros(closes_at)", "in_session").collect()
    micros = lambda t: int(t.timestamp() * 1_000_000)
    expected = set()
    for _, ex, at, *_ in rows:
        if ex in (1, 2, 3, 4):
            d, a, b, on = plain(ex, at)
            expected.add((ex, micros(utc(at)), d, micros(a), micros(b), on))
        else:
            expected.add((ex, micros(at), None, None, None, False))
    assert {tuple(r) for r in got} == expected and len({on for *_, on in expected}) == 2


def test_windows_go_from_the_opening(spark, sessions):
    """A summer and a winter day of New York: 09:30 is another instant, the windows are the same ones of the session."""
    out = {}
    for day, opened in (((2024, 7, 1), 13), ((2024, 12, 2), 14)):
        first = dt.datetime(*day, opened, 30, tzinfo=dt.UTC)
        rows = [(1, 1, first + dt.timedelta(minutes=m), float(m), m + 0.5, m - 0.5, m + 0.25, 1.0) for m in (-1, 0, 1, 44, 45, 46, 89, 389, 390)]
        bars = intraday.resample(spark.createDataFrame(rows, BARS), sessions, "45m").collect()
        out[day] = sorted((round((r["ts"].astimezone(dt.UTC) - first).total_seconds() / 60), r["open"], r["high"], r["low"], r["close"], r["volume"], r["market_date"]) for r in bars)
    for day, bars in out.items():
        d = dt.date(*day)
        assert bars == [(0, 0.0, 44.5, -0.5, 44.25, 3.0, d), (45, 45.0, 89.5, 44.5, 89.25, 3.0, d), (360, 389.0, 389.5, 388.5, 389.25, 1.0, d)]


def test_night_session_is_one_bar(spark, sessions):
    """Chicago, over the change of clocks of March 10: the session of Monday begins on Sunday."""
    at = [dt.datetime(2024, 3, 10, 22, 0, tzinfo=dt.UTC), dt.datetime(2024, 3, 11, 12, 0, tzinfo=dt.UTC), dt.datetime(2024, 3, 11, 20, 59, tzinfo=dt.UTC), dt.datetime(2024, 3, 11, 21, 30, tzinfo=dt.UTC)]
    rows = [(1, 3, t, float(i), float(i), float(i), float(i), 2.0) for i, t in enumerate(at)]
    (r,) = intraday.resample(spark.createDataFrame(rows, BARS), sessions, "1d").collect()
    assert (r["market_date"], r["ts"].astimezone(dt.UTC), r["open"], r["close"], r["volume"]) == (dt.date(2024, 3, 11), at[0], 0.0, 2.0, 6.0)


def test_holidays_have_no_bars(spark, sessions):
    rows = [(1, 2, dt.datetime(2024, 7, d, 6, 0, tzinfo=dt.UTC), 1.0, 1.0, 1.0, 1.0, 1.0) for d in (3, 4, 5, 6, 7)]  # Wednesday to Sunday
    holidays = spark.createDataFrame([(2, dt.date(2024, 7, 4), "full_day"), (2, dt.date(2024, 7, 5), "half_day"), (2, dt.date(2024, 7, 7), "half_day"), (1, dt.date(2024, 7, 3), "full_day")], "exchange_id long, holiday_date date, session_type string")
    got = intraday.resample(spark.createDataFrame(rows, BARS), sessions, "1d", holidays=holidays).collect()
    assert sorted(r["market_date"].day for r in got) == [3, 5, 7]


def test_intervals(spark, sessions):
    assert [intraday.interval_seconds(x) for x in ("1s", "1m", "30m", "2h", "1d")] == [1, 60, 1800, 7200, 86_400]
    for x in ("", "0m", "1", "m", "1w", "-1m", "2d"):
        with pytest.raises(InvalidArgument):
            intraday.interval_seconds(x)
    assert intraday.resample(spark.createDataFrame([], BARS), sessions, "1m").count() == 0


def test_datasets_of_minutes(spark, sessions):
    """Bars of one day are bars of their own for features and labels."""
    first = dt.datetime(2024, 7, 1, 13, 30, tzinfo=dt.UTC)
    rows = [(1, 1, first + dt.timedelta(minutes=m), float(m + 1), float(m + 1), float(m + 1), float(m + 1), 1.0) for m in range(10)]
    minutes = intraday.resample(spark.createDataFrame(rows, BARS), sessions, "1m")
    got = dataset.build(minutes, [Feature("return", {"window": 1})], Target("forward_return", 2), order="ts").rows.orderBy("observation_date").collect()
    assert len(got) == 7 and got[0]["return_window_1"] == 1.0 and got[0]["target"] == 1.0
    assert (got[0]["realization_date"] - got[0]["observation_date"]).total_seconds() == 120
    actions = spark.createDataFrame([(1, "dividend", dt.date(2024, 7, 1), 1.0)], "instrument_id long, action_type string, execution_date date, value double")
    total = dataset.build(minutes, [Feature("return", {"window": 1})], Target("total_return", 2), actions, order="ts").rows.orderBy("observation_date").collect()
    assert [r["target"] for r in total] == [r["target"] for r in got]  # the ex-date is their own day
