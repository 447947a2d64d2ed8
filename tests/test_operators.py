"""Splits, lookups, calendar, upserts, quality rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, InvalidData, RateLimited, provider_error
from tidemark.functions import scalars
from tidemark.operators import calendar, ingestion, lookups, quality, security_master, split, upsert
from tidemark.sources import tables

DAY0 = dt.date(2024, 1, 1)


def rows(spark, n, h, ident=1):
    return spark.createDataFrame(
        [(ident, DAY0 + dt.timedelta(days=i), DAY0 + dt.timedelta(days=i + h)) for i in range(n)], "instrument_id long, observation_date date, realization_date date"
    )


@pytest.mark.parametrize(
    ("n", "h", "embargo", "expected"),
    [
        (20, 1, 0, dict(train_kept=14, val_kept=3, test_kept=3, val_purged=0, test_purged=0)),
        (40, 3, 0, dict(val_purged=2, val_kept=4)),
        (30, 3, 0, dict(val_purged=2, val_kept=2, test_purged=2)),
        (20, 1, 2, dict(val_kept=1, test_kept=1, val_embargoed=2, test_embargoed=2)),
    ],
)
def test_split(spark, n, h, embargo, expected):
    source = rows(spark, n, h)
    config = split.SplitConfig(embargo=embargo)
    parts = split.split(source, config)
    got = split.summary(parts).first().asDict()
    assert {k: got[k] for k in expected} == expected and got["total"] == n
    report = split.verify(parts, source, config).first()
    assert (report["leaks"], report["extra"], report["missing"], report["misplaced"], report["misjudged"]) == (False, 0, 0, 0, 0)
    assert split.require_verified(parts, source, config) is parts


def test_verification_finds_tampering(spark):
    source, config = rows(spark, 40, 3), split.SplitConfig()
    parts = split.split(source, config)
    report = lambda p, c=config: split.verify(p, source, c).first()
    leaky = parts.withColumn("status", F.lit("kept"))
    assert report(leaky)["leaks"] and report(leaky)["misjudged"] > 0
    assert report(parts.where("observation_date <> '2024-01-05'"))["missing"] == 1
    assert report(parts.unionByName(parts.limit(1)))["extra"] == 1
    moved = parts.withColumn("segment", F.when(F.col("segment") == "val", "test").otherwise(F.col("segment")))
    assert report(moved)["misplaced"] == 6
    assert report(parts, split.SplitConfig(embargo=1))["misjudged"] == 2
    for bad in (leaky, moved):
        with pytest.raises(InvalidData):
            split.require_verified(bad, source, config)


def test_split_without_purge(spark):
    source = rows(spark, 40, 3)
    config = split.SplitConfig(embargo=2, purge_overlap=False)
    parts = split.split(source, config)
    got = split.summary(parts).first().asDict()
    assert {k: got[k] for k in ("val_purged", "test_purged", "val_embargoed", "test_embargoed", "val_kept")} == dict(val_purged=0, test_purged=0, val_embargoed=2, test_embargoed=2, val_kept=4)
    assert not split.verify(parts, source, config).first()["leaks"]
    with pytest.raises(InvalidArgument):
        split.SplitConfig(purge_overlap=1)


def test_dense_parts(spark):
    source = rows(spark, 40, 3).withColumns({"f": F.day("observation_date").cast("double"), "g": F.lit(2.0), "target": F.lit(1.0)})
    parts = split.dense_parts(split.split(source, split.SplitConfig()), ["g", "f"])
    assert {s: p.count() for s, p in parts.items()} == {"train": 28, "val": 4, "test": 4}
    assert [r["x"] for r in parts["val"].orderBy("observation_date").collect()][0] == [2.0, 31.0]


def test_small_series_are_rejected(spark):
    parts = split.split(rows(spark, 3, 1), split.SplitConfig())
    assert split.summary(parts).first()["rejected"]
    with pytest.raises(InvalidData):
        split.require_complete(parts)
    for bad in (dict(train=0.9, val=0.2), dict(embargo=-1), dict(embargo=True)):
        with pytest.raises(InvalidArgument):
            split.SplitConfig(**bad)


def test_calendar(spark):
    ex = spark.createDataFrame([(1,)], "exchange_id int")
    h = spark.createDataFrame([(1, dt.date(2026, 8, 14), "full_day"), (1, dt.date(2026, 8, 15), "half_day"), (1, dt.date(2026, 8, 13), "early_close")], "exchange_id int, holiday_date date, session_type string")
    days = calendar.trading_days(ex, h.where("session_type = 'full_day'"), "2026-08-10", "2026-08-16")
    assert sorted(r["date"].day for r in days.collect()) == [10, 11, 12, 13]
    days = calendar.trading_days(ex, h, "2026-08-10", "2026-08-16")
    assert sorted(r["date"].day for r in days.collect()) == [10, 11, 12, 13, 15]
    assert calendar.calendar(ex, h, "2026-08-10", "2026-08-16").where("is_holiday").count() == 3


def test_history(spark):
    d = dt.date
    history = spark.createDataFrame([(1, "A", d(2020, 1, 1), d(2022, 12, 31)), (1, "B", d(2023, 1, 1), None)], "instrument_id long, symbol string, effective_from date, effective_to date")
    now = spark.createDataFrame([(1, "NOW")], "instrument_id long, symbol string")
    days = spark.createDataFrame([(1, d(2020, 1, 1)), (1, d(2022, 12, 31)), (1, d(2023, 1, 1)), (1, d(2019, 12, 31))], "instrument_id long, date date")
    got = {r["date"]: r["symbol"] for r in lookups.symbols_as_of(days, history, now).collect()}
    assert got == {d(2020, 1, 1): "A", d(2022, 12, 31): "A", d(2023, 1, 1): "B", d(2019, 12, 31): "NOW"}
    change = spark.createDataFrame([(1, " c ", d(2024, 5, 1))], "instrument_id long, new_symbol string, effective date")
    after = security_master.change_symbols(history, change).orderBy("effective_from").collect()
    assert [(r["symbol"], r["effective_to"]) for r in after] == [("A", d(2022, 12, 31)), ("B", d(2024, 4, 30)), ("C", None)]
    early = spark.createDataFrame([(1, "c", d(2023, 1, 1))], "instrument_id long, new_symbol string, effective date")
    with pytest.raises(Exception, match="before the open row"):
        security_master.change_symbols(history, early).collect()


def test_point_in_time(spark):
    schema = "instrument_id long, period_end date, metric_name string, value double, published_at date, available_at date"
    d = dt.date
    r = spark.createDataFrame([(1, d(2024, 3, 31), "revenue", 1.0, None, d(2024, 5, 1)), (1, d(2024, 6, 30), "revenue", 2.0, None, d(2024, 8, 1)), (1, d(2024, 9, 30), "revenue", 3.0, None, None)], schema)
    assert [lookups.fundamentals_as_of(r, x).count() for x in ("2024-04-30", "2024-05-01", "2030-01-01")] == [0, 1, 2]
    days = spark.createDataFrame([(1, d(2024, 4, 30)), (1, d(2024, 5, 1)), (1, d(2025, 1, 1)), (2, d(2025, 1, 1))], "instrument_id long, date date")
    got = lookups.as_of_join(days, r, ["instrument_id"], "date", "available_at", ["value"]).orderBy("instrument_id", "date").collect()
    assert [x["value"] for x in got] == [None, 1.0, 2.0, None]
    with pytest.raises(InvalidArgument):
        lookups.check_range("2024-02-01", "2024-01-01")


def test_upsert_lifecycle(spark):
    schema = "k long, v double, id string"
    new = spark.createDataFrame([(i, float(i), f"n{i}") for i in range(500)], schema)
    empty = spark.createDataFrame([], schema)
    revised = spark.createDataFrame([(i, float(i) + (i < 200), f"r{i}") for i in range(500)], schema)
    n = lambda a, b: tuple(upsert.counts(upsert.classify(a, b, ["k"], ["v"]).withColumn("g", F.lit(1)), ["g"]).first()[1:])
    assert n(new, empty) == (500, 500, 0, 0) and n(new, new) == (500, 0, 0, 500) and n(revised, new) == (500, 0, 200, 300)
    after = {r["k"]: r for r in upsert.upsert(revised, new, ["k"], surrogate="id").collect()}
    assert len(after) == 500 and after[5]["v"] == 6.0 and after[5]["id"] == "n5"
    keyed = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k long, v double")
    assert {r["status"] for r in upsert.classify(keyed, keyed, ["k"], ["v"]).collect()} == {"skipped"}
    twice = spark.createDataFrame([(1, 1.0, 0), (1, 2.0, 1)], "k long, v double, arrival int")
    assert upsert.last_arrivals(twice, ["k"], "arrival").first()["v"] == 2.0


def test_quality(spark):
    d = dt.date
    b = spark.createDataFrame(
        [(0, 2, d(2024, 1, 2)), (1, 1, None), (2, 1, d(2025, 1, 1)), (3, 1, d(2024, 1, 3)), (4, 1, d(2024, 1, 3)), (5, 1, d(2024, 1, 2))], "batch_index int, instrument_id long, date date"
    )
    got = quality.bar_batch(b, 1, "2024-01-01", "2024-12-31").orderBy("batch_index").collect()
    assert [(r["violation"], r["is_first"]) for r in got] == [("wrong_instrument", True), ("no_timestamp", False), ("out_of_range", False), ("duplicate", False)]
    assert [r["batch_index"] for r in quality.out_of_order(b.where("batch_index > 1")).collect()] == [3, 5]
    a = spark.createDataFrame([("merger", 1.0, None), ("split", float("nan"), None), ("split", 0.0, None), ("dividend", 1.0, " "), ("dividend", 1.0, "USD")], "action_type string, value double, currency string")
    assert quality.violations(a, quality.action_rules()).count() == 4


def test_scalars(spark):
    df = spark.createDataFrame([(" us0378331005 ", "NSE", "abc"), ("US037833100X", "BSE", "x")], "isin string, exchange string, symbol string")
    assert [r[0] for r in df.select(scalars.is_isin(F.col("isin"))).collect()] == [True, False]
    assert [r[0] for r in df.select(tables.provider_ticker(F.col("symbol"), F.col("exchange"))).collect()] == ["ABC.NS", "X.BO"]
    with pytest.raises(Exception, match="no provider ticker"):
        df.select(tables.provider_ticker(F.col("symbol"), F.lit("LSE"))).collect()
    assert isinstance(provider_error(RuntimeError("HTTP 429"), "X"), RateLimited)
    ts = spark.sql("SELECT TIMESTAMP '2026-01-04 18:30:00' AS t")
    assert ts.select(scalars.market_date(F.col("t"), "Asia/Kolkata")).first()[0] == dt.date(2026, 1, 5)
    assert ts.select(scalars.market_date(F.col("t"))).first()[0] == dt.date(2026, 1, 4)


def test_unpivot_skips_null_and_nan(spark):
    wide = spark.createDataFrame([(1, dt.date(2024, 3, 31), 1.0, float("nan")), (1, dt.date(2024, 6, 30), None, 2.0), (1, dt.date(2025, 3, 31), 9.0, 9.0)], "instrument_id long, period_end date, a double, b double")
    got = tables.unpivot_fundamentals(wide, ["instrument_id", "period_end"], ["a", "b"], "2024-01-01", "2024-12-31").collect()
    assert sorted((r["metric_name"], r["value"]) for r in got) == [("a", 1.0), ("b", 2.0)]


BATCH = "batch_index int, instrument_id long, date date, open double, high double, low double, close double, volume double"


def test_ingestion_runs(spark):
    """500 new, the same again, 200 revised; and runs that fail for each reason."""
    bars = lambda change=lambda i: 0.0, ident=1, n=500: [(i, ident, DAY0 + dt.timedelta(days=i), 10.0, 20.0, 5.0, 10.0 + change(i), 1.0) for i in range(n)]
    requested = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "instrument_id long")
    store = spark.createDataFrame([], BATCH).drop("batch_index")

    def run(data, store):
        out = ingestion.ingest_bars(spark.createDataFrame(data, BATCH), store, requested, "2024-01-01", "2026-12-31")
        return out.table, {r["instrument_id"]: (r["status"], r["received_count"], r["inserted_count"], r["updated_count"], r["skipped_count"], r["error_message"]) for r in out.runs.collect()}

    store, runs = run(bars(), store)
    assert runs[1] == ("SUCCESS", 500, 500, 0, 0, None) and runs[2] == ("SUCCESS", 0, 0, 0, 0, None)
    store, runs = run(bars(), store)
    assert runs[1] == ("SUCCESS", 500, 0, 0, 500, None)
    store, runs = run(bars(lambda i: 1.0 if i < 200 else 0.0), store)
    assert runs[1] == ("SUCCESS", 500, 0, 200, 300, None) and store.count() == 500
    odd = [(0, 2, DAY0, 10.0, 5.0, 6.0, 6.0, 1.0), (1, 3, dt.date(2030, 1, 1), 1.0, 1.0, 1.0, 1.0, 1.0), (0, 4, DAY0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, 4, DAY0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    odd += [(0, 5, DAY0, None, 1.0, 1.0, 1.0, 1.0), (1, 5, None, 1.0, 1.0, 1.0, 1.0, 1.0), (0, 9, DAY0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    after, runs = run([*bars(lambda i: 2.0), *odd], store)
    assert {k: v[-1] for k, v in runs.items()} == {1: None, 2: "high_below_low", 3: "out_of_range", 4: "duplicate", 5: "missing", 9: "unknown_instrument"}
    assert all(v[:2] == ("FAILED", 0) for k, v in runs.items() if k > 1) and after.select("instrument_id").distinct().count() == 1


def test_fundamental_rules(spark):
    r = spark.createDataFrame(
        [("2024-01-01T00:00:00Z", "usd"), ("2024-01-01 00:00:00+05:30", None), ("2024-01-01T00:00:00", "usd"), ("2024-01-01", " "), (None, "")], "available_at string, currency string"
    )
    zones, money = quality.zone_rules("available_at"), quality.currency_rule()
    assert {x["available_at"] for x in quality.violations(r, zones).collect()} == {"2024-01-01T00:00:00", "2024-01-01"}
    assert sorted(x["currency"] for x in quality.violations(r, money).collect()) == ["", " "]


def test_required_dataset(spark):
    one = spark.createDataFrame([(1, DAY0, DAY0 + dt.timedelta(days=1), 1.0, 2.0)], "instrument_id long, observation_date date, realization_date date, f double, target double")
    assert quality.require_dataset(one, ["f"], 1) is one
    for df, names, ident in ((one, ["f", "f"], None), (one, [], None), (one, ["f"], 2), (one.limit(0), ["f"], None), (one.withColumn("target", F.lit(float("nan"))), ["f"], None), (one.withColumn("realization_date", F.col("observation_date")), ["f"], None)):
        with pytest.raises((InvalidData, InvalidArgument)):
            quality.require_dataset(df, names, ident)


def test_several_changes_of_one_instrument(spark):
    d = dt.date
    history = spark.createDataFrame([(1, "A", d(2020, 1, 1), None), (2, "Z", d(2020, 1, 1), None)], "instrument_id long, symbol string, effective_from date, effective_to date")
    schema = "instrument_id long, new_symbol string, effective date"
    changes = spark.createDataFrame([(1, "c", d(2022, 1, 1)), (1, "b", d(2021, 1, 1))], schema)
    got = [tuple(r) for r in security_master.change_symbols(history, changes).orderBy("instrument_id", "effective_from").collect()]
    assert got == [(1, "A", d(2020, 1, 1), d(2020, 12, 31)), (1, "B", d(2021, 1, 1), d(2021, 12, 31)), (1, "C", d(2022, 1, 1), None), (2, "Z", d(2020, 1, 1), None)]
    now = spark.createDataFrame([(1, "A", "active"), (2, "Z", "active")], "instrument_id long, symbol string, status string")
    assert {r["instrument_id"]: r["symbol"] for r in security_master.current_symbols(now, changes).collect()} == {1: "C", 2: "Z"}
    stopped = security_master.set_status(now, spark.createDataFrame([(2, " Delisted ")], "instrument_id long, new_status string"))
    assert {r["instrument_id"]: r["status"] for r in stopped.collect()} == {1: "active", 2: "delisted"}
    for bad, match in ((spark.createDataFrame([(1, "b", None)], schema), "no date"),):
        with pytest.raises(Exception, match=match):
            security_master.change_symbols(history, bad).collect()
    with pytest.raises(Exception, match="unknown status"):
        security_master.set_status(now, spark.createDataFrame([(2, "gone")], "instrument_id long, new_status string")).collect()


def test_registration(spark):
    companies, exchanges = spark.createDataFrame([(1,)], "company_id long"), spark.createDataFrame([(7, "NSE", "x")], "exchange_id long, code string, country string")
    old = spark.createDataFrame([(1, "A")], "instrument_id long, symbol string")
    schema = "instrument_id long, company_id long, code string, symbol string, isin string"
    rows, history = security_master.register_instruments(spark.createDataFrame([(2, 1, " nse", " new ", "ine123456789")], schema), old, companies, exchanges, "2024-01-01")
    assert tuple(rows.first()) == (2, 1, 7, "NEW", "INE123456789", "active") and history.first()["effective_from"] == DAY0
    for row, match in (((1, 1, "NSE", "A", "INE123456789"), "is there already"), ((2, 9, "NSE", "A", "INE123456789"), "company"), ((2, 1, "X", "A", "INE123456789"), "exchange"), ((2, 1, "NSE", "A", "bad"), "ISIN")):
        with pytest.raises(Exception, match=match):
            security_master.register_instruments(spark.createDataFrame([row], schema), old, companies, exchanges, "2024-01-01")[0].collect()


def test_saving_by_the_keys_of_the_schema(spark, tmp_path):
    at = "holiday_id string, exchange_id string, holiday_date date, name string, session_type string"
    old = spark.createDataFrame([("h1", "e", DAY0, "New Year", "full_day")], at)
    new = spark.createDataFrame([("h2", "e", DAY0, "New Year", "half_day"), ("h3", "e", DAY0 + dt.timedelta(days=1), "x", "half_day")], at)
    saved = upsert.save(new, old, "market_holidays", surrogate="holiday_id")
    assert sorted(tuple(r)[0::4] for r in saved.collect()) == [("h1", "half_day"), ("h3", "half_day")]
    saved.write.parquet(str(tmp_path / "h"))
    assert tables.read_domain(spark, str(tmp_path / "h"), "market_holidays").count() == 2
    arrivals = spark.createDataFrame([("c1", "A", 1), ("c1", "B", 2)], "company_id string, name string, n int")
    assert [r["name"] for r in upsert.save(arrivals, arrivals.limit(0).drop("n"), "companies", "n").collect()] == ["B"]


def test_small_lookups(spark):
    ex = spark.createDataFrame([(1, "NSE", "x"), (2, "BSE", "y")], "exchange_id long, code string, country string")
    ins = spark.createDataFrame([(1, 1, "A"), (2, 2, "A")], "instrument_id long, exchange_id long, symbol string")
    bars = spark.createDataFrame([(i, DAY0 + dt.timedelta(days=k), float(k)) for i in (1, 2) for k in range(3)], "instrument_id long, date date, close double")
    assert [(r["instrument_id"], r["close"]) for r in lookups.latest_bar_by_symbol(bars, ins, ex, " a", "bse").collect()] == [(2, 2.0)]
    assert lookups.instrument_by_symbol(ins, ex, "a ", "nse").first()["instrument_id"] == 1
    assert lookups.by_id(ins, "instrument_id", 2).count() == 1 and lookups.by_id(ins, "instrument_id", 3).count() == 0
    h = spark.createDataFrame([(1, dt.date(2026, 8, 14), "full_day"), (2, dt.date(2026, 8, 14), "half_day"), (1, dt.date(2027, 1, 1), "full_day")], "exchange_id long, holiday_date date, session_type string")
    assert calendar.holiday_on(h, 2, "2026-08-14").first()["session_type"] == "half_day" and calendar.holiday_on(h, 2, "2027-01-01").count() == 0
    assert calendar.holidays_of_year(h, 1, 2026).count() == 1


def test_time_stamps_in_text(spark):
    texts = {
        "2024-03-10T07:30:00": "2024-03-10 07:30:00", "2024-03-10 07:30:00.25": "2024-03-10 07:30:00.25", "2024-03-10T07:30:00Z": "2024-03-10 07:30:00", "2024-03-10T07:30:00+05:30": "2024-03-10 02:00:00",
        "2024-03-10T07:30:00-0300": None, "2024-03-10 07:30:00 America/New_York": "2024-03-10 11:30:00", "2024-03-10": "2024-03-10 00:00:00", "soon": None, None: None, "": None, "07:30:00": None,
    }
    from tidemark.functions.scalars import utc_timestamp

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    was = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got = {r["t"]: r["u"] for r in df.select("t", F.to_utc_timestamp(utc_timestamp(F.col("t")), zone).cast("string").alias("u") if zone != "UTC" else utc_timestamp(F.col("t")).cast("string").alias("u")).collect()}
            assert {k: v for k, v in got.items() if k != "2024-03-10T07:30:00-0300"} == {k: v for k, v in texts.items() if k != "2024-03-10T07:30:00-0300"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_ranges_are_checked(spark):
    from tidemark.operators import calendar, ingestion, lookups, quality
    from tidemark.sources import tables

    df = spark.createDataFrame([], "instrument_id long, exchange_id long, date date, holiday_date date, session_type string, period_end date, available_at date, execution_date date, action_type string, metric_name string, fiscal_year int, fiscal_quarter int, batch_index long, m double")
    a, b = "2024-02-01", "2024-01-01"
    for call in (
        lambda: lookups.bars_in_range(df, 1, a, b), lambda: lookups.actions_of(df, 1, a, b), lambda: lookups.fundamentals_as_of(df, b, a, b), lambda: calendar.holidays_in_range(df, a, b),
        lambda: calendar.trading_days(df, df, a, b), lambda: tables.unpivot_fundamentals(df, ["instrument_id"], ["m"], a, b), lambda: quality.bar_batch(df, 1, a, b), lambda: quality.fundamental_batch(df, a, b),
        lambda: ingestion.ingest_bars(df, df, df, a, b), lambda: ingestion.ingest_fundamentals(df, df, df, a, b),
    ):
        with pytest.raises(InvalidArgument, match="the range begins at"):
            call()


def test_order_of_nulls(spark):
    from tidemark.operators import lookups

    rows = [(1, None, "a"), (1, dt.date(2024, 1, 2), None), (1, dt.date(2024, 1, 2), "b"), (1, dt.date(2024, 1, 1), "z")]
    df = spark.createDataFrame(rows, "instrument_id long, execution_date date, action_type string")
    assert [tuple(r) for r in lookups.actions_of(df, 1).collect()] == [rows[3], rows[2], rows[1], rows[0]]
    runs = spark.createDataFrame([(1, None, 5), (1, 3, 1), (1, 3, None), (1, 2, 9)], "k long, t long, i long")
    assert [(r["t"], r["i"]) for r in lookups.newest(runs, ["k"], "t", "i", 4).orderBy("rank").collect()] == [(3, 1), (3, None), (2, 9), (None, 5)]
