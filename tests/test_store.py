"""Tables on disk and runs of ingestion: what is written, what is left alone, and what happens when something breaks off."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, InvalidData
from tidemark.functions.scalars import strict_float64
from tidemark.operators import ingestion
from tidemark.operators.store import KeyedTable, open_table
from tidemark.operators.upsert import upsert
from tidemark.schemas import KEYS, PARTS, SURROGATES, TABLES, Part
from tidemark.streaming import bars as streaming

UTC = dt.UTC
D = Decimal


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-") and "/_" not in d}


def sample(name, i, changed=False):
    """A row of a table; with ``changed`` another value beside the same key."""
    out = []
    for f in TABLES[name].fields:
        kind, key = f.dataType.simpleString(), f.name in KEYS[name]
        k = i if key or not changed else i + 1000
        out.append({"string": f"{f.name}{k}", "date": dt.date(2020 + k % 4, 1 + k % 12, 1 + k % 28), "timestamp": dt.datetime(2020 + k % 4, 1 + k % 12, 1, k % 24), "int": k, "boolean": k % 2 == 0}.get(kind, D(k)))
    return tuple(out)


def normal(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


@pytest.mark.parametrize("name", list(TABLES))
def test_every_table_is_upserted(spark, tmp_path, name):
    assert set(KEYS) == set(PARTS) == set(TABLES) and set(SURROGATES) <= set(TABLES)
    frame = lambda rows: spark.createDataFrame(rows, TABLES[name])
    t = open_table(spark, str(tmp_path / name), name)
    assert t.read().count() == 0 and t.read().schema == TABLES[name]
    old = frame([sample(name, i) for i in range(60)])
    assert (s := t.save(old)).inserted == 60 == s.received and normal(t.read().collect()) == normal(old.collect())
    new = frame([sample(name, i, True) for i in range(50, 55)] + [sample(name, i) for i in range(55, 58)] + [sample(name, 70)])
    s = t.save(new)
    assert (s.received, s.inserted, s.updated, s.skipped) == (9, 1, 5, 3)
    expected = upsert(new, old, KEYS[name], SURROGATES.get(name))
    assert normal(t.read().collect()) == normal(expected.collect()) and t.read().count() == 61
    if name in SURROGATES:
        kept = {r[KEYS[name][0]]: r[SURROGATES[name]] for r in t.read().collect()}
        first = old.collect()[50]
        assert kept[first[KEYS[name][0]]] == first[SURROGATES[name]]


BAR = "instrument_id long, date date, close double"


def bar_rows(spark, rows):
    return spark.createDataFrame([(i, dt.date(2026, m, d), float(c), a) for i, m, d, c, a in rows], BAR + ", arrival long")


def test_files_of_other_partitions_stay(spark, tmp_path):
    t = streaming.bar_table(spark, str(tmp_path / "bars"), spark.createDataFrame([], BAR).schema)
    t.save(bar_rows(spark, [(i, m, 1, 1, 0) for i in range(20) for m in (1, 2, 3)]), "arrival")
    before = files(t.path)
    s = t.save(bar_rows(spark, [(1, 2, 1, 5, 1), (1, 2, 1, 7, 2), (1, 2, 1, 6, 0), (2, 3, 1, 1, 0)]), "arrival")
    after = files(t.path)
    assert (s.received, s.updated, s.skipped) == (2, 1, 1)  # in March nothing changes
    gone = {f.split("kt_part=")[1][:7] for f in before if after.get(f) != before[f]}
    assert gone == {"2026-02"} and t.read().where("instrument_id = 1 and month(date) = 2").first()["close"] == 7.0
    assert t.save(bar_rows(spark, [(2, 3, 1, 1, 0)]), "arrival").skipped == 1 and files(t.path) == after
    assert "PartitionFilters: [isnotnull(kt_part" in t.read(["2026-01"])._jdf.queryExecution().toString() or t.read(["2026-01"]).count() == 20


def test_a_key_twice_raises(spark, tmp_path):
    t = streaming.bar_table(spark, str(tmp_path / "bars"), spark.createDataFrame([], BAR).schema)
    with pytest.raises(Exception, match="a key comes twice"):
        t.save(bar_rows(spark, [(1, 1, 1, 1, 0), (1, 1, 1, 2, 0)]))
    assert t.read().count() == 0
    with pytest.raises(InvalidArgument):
        KeyedTable(spark, "x", t.schema, ["instrument_id"], Part("date", "year"))


def test_null_keys(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), spark.createDataFrame([], "k long, d date, v long").schema, ["k", "d"], Part("d", "year"))
    rows = spark.createDataFrame([(None, None, 1), (1, None, 2), (None, dt.date(2024, 1, 1), 3)], "k long, d date, v long")
    t.save(rows)
    assert t.save(rows.withColumn("v", F.col("v") + 1)).updated == 3 and sorted(r["v"] for r in t.read().collect()) == [2, 3, 4]


def test_a_batch_again_counts_alike(spark, tmp_path):
    """Also if it broke off after the table was written."""
    t = streaming.bar_table(spark, str(tmp_path / "bars"), spark.createDataFrame([], BAR).schema)
    batch = bar_rows(spark, [(1, 1, 1, 2, 0), (2, 1, 1, 2, 0)])
    counts = lambda s: (s.inserted, s.updated, s.skipped)
    assert counts(t.save(batch, "arrival", "b1")) == (2, 0, 0) == counts(t.save(batch, "arrival", "b1"))
    t.forget("b1")
    assert counts(t.save(batch, "arrival", "b1")) == (0, 0, 2)


MINUTE = "instrument_id string, timestamp timestamp, open decimal(18,6), high decimal(18,6), low decimal(18,6), close decimal(18,6), volume decimal(24,6), batch_index long, market_bar_id string"


def minutes(spark, n=500, changed=0):
    """Minute bars (fixed values)."""
    first = dt.datetime(2026, 1, 1, 9, 15, tzinfo=UTC)
    rows = []
    for i in range(n):
        new = i < changed
        rows.append(("a", first + dt.timedelta(minutes=i), D(100 + i), D((120 if new else 110) + i), D(90 + i), D((115 if new else 105) + i), D(1000 + i), i, f"id{i}"))
    return spark.createDataFrame(rows, MINUTE)


def ingest(spark, tmp_path, batch, run_id, asked=("a",)):
    bars, runs = open_table(spark, str(tmp_path / "bars"), "market_bars"), open_table(spark, str(tmp_path / "runs"), "ingestion_runs")
    requested = spark.createDataFrame([(x,) for x in asked], "instrument_id string")
    out = ingestion.run_bars(batch, bars, runs, requested, "2026-01-01 00:00:00", "2026-01-01 23:59:00", "fake", run_id, order="timestamp")
    return bars, runs, out


def test_minute_bars(spark, tmp_path):
    """500 bars, the same again, then 200 of them changed."""
    counts = lambda r: (r["received_count"], r["inserted_count"], r["updated_count"], r["skipped_count"], r["status"])
    bars, _, out = ingest(spark, tmp_path, minutes(spark), "r1")
    assert counts(out.first()) == (500, 500, 0, 0, "SUCCESS") and bars.read().count() == 500
    before = files(bars.path)
    assert counts(ingest(spark, tmp_path, minutes(spark), "r2")[2].first()) == (500, 0, 0, 500, "SUCCESS") and files(bars.path) == before
    assert counts(ingest(spark, tmp_path, minutes(spark, 500, 200), "r3")[2].first()) == (500, 0, 200, 300, "SUCCESS")
    got = [r["close"] for r in bars.read().orderBy("timestamp").collect()]
    assert got == [D(115 + i) if i < 200 else D(105 + i) for i in range(500)] and bars.read().where("market_bar_id is null").count() == 0


def test_runs(spark, tmp_path):
    good = minutes(spark, 5)
    late = good.withColumns({"instrument_id": F.lit("late"), "batch_index": F.when(F.col("batch_index") == 1, 4).when(F.col("batch_index") == 4, 1).otherwise(F.col("batch_index"))})
    low = good.withColumns({"instrument_id": F.lit("low"), "high": F.when(F.col("batch_index") == 3, F.col("low") - 1).otherwise(F.col("high"))})
    other, early = good.withColumn("instrument_id", F.lit("other")), good.withColumns({"instrument_id": F.lit("early"), "timestamp": F.expr("timestamp - interval 1 day")})
    batch = good.union(late).union(low).union(other).union(early)
    bars, runs, out = ingest(spark, tmp_path, batch, "r1", ("a", "late", "low", "early", "none"))
    got = {r["instrument_id"]: r for r in out.collect()}
    assert {k: (r["status"], r["error_message"], r["received_count"]) for k, r in got.items()} == {
        "a": ("SUCCESS", None, 5), "late": ("FAILED", "out_of_order", 0), "low": ("FAILED", "high_below_low", 0),
        "other": ("FAILED", "unknown_instrument", 0), "early": ("FAILED", "out_of_range", 0), "none": ("SUCCESS", None, 0),
    }
    assert all(r["completed_at"] >= r["started_at"] and r["provider"] == "fake" and r["ingestion_type"] == "price" and r["run_id"] == f"r1:{k}" for k, r in got.items())
    assert {r[0] for r in bars.read().select("instrument_id").distinct().collect()} == {"a"}
    with pytest.raises(InvalidData, match="out_of_order|unknown|low"):
        ingestion.require_success(out)
    # A run that has ended is not done again.
    again = ingest(spark, tmp_path, minutes(spark, 5, 5), "r1", ("a",))[2]
    assert normal(again.collect()) == normal(out.collect()) and bars.read().where("high > 120").count() == 0
    assert runs.read().count() == 6


def test_a_run_that_breaks_off(spark, tmp_path, monkeypatch):
    """The table is as it was, the run has failed with the message; a run that died in RUNNING is done, with its first counts."""
    ingest(spark, tmp_path, minutes(spark, 5), "r1")
    real = KeyedTable.save

    def broken(self, rows, arrival=None, batch=None):
        if batch == "r2":
            raise RuntimeError("store is gone")
        return real(self, rows, arrival, batch)

    monkeypatch.setattr(KeyedTable, "save", broken)
    with pytest.raises(RuntimeError, match="store is gone"):
        ingest(spark, tmp_path, minutes(spark, 5, 5), "r2")
    bars, runs = open_table(spark, str(tmp_path / "bars"), "market_bars"), open_table(spark, str(tmp_path / "runs"), "ingestion_runs")
    r = runs.read().where("run_id = 'r2:a'").first()
    assert (r["status"], r["error_message"], r["received_count"]) == ("FAILED", "store is gone", 0) and r["completed_at"] is not None
    assert bars.read().where("high > 115").count() == 0

    def dies(self, rows, arrival=None, batch=None):
        out = real(self, rows, arrival, batch)
        if batch == "r3":  # after the table was written
            raise KeyboardInterrupt
        return out

    monkeypatch.setattr(KeyedTable, "save", dies)
    with pytest.raises(KeyboardInterrupt):
        ingest(spark, tmp_path, minutes(spark, 6, 3), "r3")
    monkeypatch.setattr(KeyedTable, "save", real)
    assert runs.read().where("run_id = 'r3:a'").first()["status"] == "RUNNING" and bars.read().count() == 6
    r = ingest(spark, tmp_path, minutes(spark, 6, 3), "r3")[2].first()
    assert (r["status"], r["inserted_count"], r["updated_count"], r["skipped_count"]) == ("SUCCESS", 1, 3, 2)


def test_fundamentals_run(spark, tmp_path):
    schema = "instrument_id string, period_end date, metric_name string, value decimal(24,6), fiscal_year int, fiscal_quarter int, published_at timestamp, available_at timestamp, batch_index long"
    row = lambda i, m, v, k: (i, dt.date(2026, m, 28), "ebitda", D(v), 2026, None if i == "b" else m // 3, None, None, k)
    batch = spark.createDataFrame([row("a", 3, 1, 0), row("a", 6, 2, 1), row("b", 3, 3, 0), row("b", 3, 3, 1)], schema)
    records, runs = open_table(spark, str(tmp_path / "r"), "fundamental_records"), open_table(spark, str(tmp_path / "runs"), "ingestion_runs")
    asked = spark.createDataFrame([("a",), ("b",)], "instrument_id string")
    got = {r["instrument_id"]: r for r in ingestion.run_fundamentals(batch, records, runs, asked, "2026-01-01", "2026-12-31", "fake", "f1").collect()}
    assert (got["a"]["inserted_count"], got["a"]["status"], got["a"]["ingestion_type"], got["b"]["error_message"]) == (2, "SUCCESS", "fundamentals", "duplicate")
    assert records.read().count() == 2


def test_doubles_are_whole(spark):
    df = spark.createDataFrame([(D("1.5"),), (D("0.000001"),)], "x decimal(18,6)")
    assert sorted(r[0] for r in df.select(strict_float64(F.col("x"), "x")).collect()) == [1e-6, 1.5]
    for bad in ("cast(null as double)", "double('NaN')", "double('inf')", "cast(null as decimal(10,2))"):
        with pytest.raises(Exception, match="has no value as a double"):
            spark.range(1).select(strict_float64(F.expr(bad), "x")).collect()
