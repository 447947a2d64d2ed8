"""Bars that arrive in files, once and again."""

import datetime as dt

from tests.test_features import BARS
from tidemark.streaming.bars import apply, audit_of, bar_table, ingest


def test_stream_upserts(spark, tmp_path):
    rows = lambda close: [(1, dt.date(2026, 1, d), 1.0, 9.0, 1.0, close, 1.0) for d in (1, 2)]
    schema = spark.createDataFrame([], BARS).schema
    table, audit = bar_table(spark, str(tmp_path / "bars"), schema), str(tmp_path / "audit")
    assert table.read().count() == 0 and audit_of(spark, audit) is None
    for i, close in enumerate((2.0, 3.0)):
        spark.createDataFrame(rows(close), BARS).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        q = ingest(stream, table, str(tmp_path / "checkpoint"), audit)
        assert q.awaitTermination(120)
        assert sorted((r["date"].day, r["close"]) for r in table.read().collect()) == [(1, close), (2, close)]
    again = spark.createDataFrame([(*r, 0) for r in rows(3.0)], BARS + ", arrival long")
    assert [r["skipped"] for r in apply(table, again, 7, audit).collect()] == [2]
    assert sorted((r["batch"], r["inserted"], r["updated"], r["skipped"]) for r in audit_of(spark, audit).collect()) == [(0, 2, 0, 0), (1, 0, 2, 0), (7, 0, 0, 2)]


def test_a_batch_that_runs_again(spark, tmp_path):
    """The table and the audit are the same, and what was kept of earlier batches is gone."""
    schema = spark.createDataFrame([], BARS).schema
    table, audit = bar_table(spark, str(tmp_path / "bars"), schema), str(tmp_path / "audit")
    day = lambda i, m, close: (i, dt.date(2026, m, 1), 1.0, 9.0, 1.0, close, 1.0, 0)
    batch = lambda *rows: spark.createDataFrame(list(rows), BARS + ", arrival long")
    apply(table, batch(*[day(i, 1, 2.0) for i in range(20)]), 0, audit)
    for n in (1, 2, 2, 2):
        got = apply(table, batch(day(5, 1, 2.0 + n), day(5, 2, 9.0 - n)), n, audit).first()
        assert (got["inserted"], got["updated"]) == ((1, 1) if n == 1 else (0, 2))
    assert {(r["instrument_id"], r["date"].month): r["close"] for r in table.read().collect()} == {**{(i, 1): 4.0 if i == 5 else 2.0 for i in range(20)}, (5, 2): 7.0}
    assert [p.name for p in (tmp_path / "bars" / "_batches").iterdir() if p.is_dir()] == ["stream-2"]
    assert sorted((r["batch"], r["received"]) for r in audit_of(spark, audit).where("instrument_id = 5").collect()) == [(0, 1), (1, 2), (2, 2)]


def stream_rows(close, days, instruments=(1, 2)):
    return [(i, dt.date(2025, 1, 1) + dt.timedelta(days=d), close(i, d), close(i, d) + 1, close(i, d) - 1, close(i, d), 1.0) for i in instruments for d in days]


def test_revisions_reach_features(spark, tmp_path):
    """New, late and revised bars, a restart from the checkpoint, and a batch again: the features are those of the bars as they are."""
    from tidemark.functions.features import Feature, add_features
    from tidemark.streaming.features import FeatureStream, follow

    own = [Feature("return", {"window": 3}), Feature("sma", {"window": 10}), Feature("rsi", {"window": 14}), Feature("atr", {"window": 5}), Feature("bollinger_bands", {"window": 7, "k": 2, "band": "upper"})]
    names, schema = [f.name for f in own], spark.createDataFrame([], BARS).schema
    make = lambda: FeatureStream(spark, str(tmp_path / "features"), bar_table(spark, str(tmp_path / "bars"), schema), own)
    wave = lambda i, d: 100.0 + i + (d * 7919 % 31) - 15
    files = [
        stream_rows(wave, [d for d in range(150) if d % 50 != 7]),
        stream_rows(wave, range(150, 170)),
        stream_rows(wave, [7, 57], [1]),  # late
        stream_rows(lambda i, d: wave(i, d) + 5, [100, 169], [2]) + stream_rows(wave, range(5), [3]),  # revised, and an instrument of its own
        stream_rows(wave, [168], [1]),  # nothing new
        stream_rows(lambda i, d: 50.0, [0], [3]),  # the first bar of all
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, BARS).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        before = {p: p.stat().st_mtime_ns for p in (tmp_path / "features").rglob("part-*") if "_batches" not in str(p)}
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        assert follow(stream, make(), str(tmp_path / "checkpoint")).awaitTermination(200)  # begun anew each time
        bars = bar_table(spark, str(tmp_path / "bars"), schema).read()
        whole = {(r["instrument_id"], r["date"]): [r[c] for c in names] for r in add_features(bars, own).collect()}
        got = {(r["instrument_id"], r["date"]): [r[c] for c in names] for r in make().read().collect()}
        assert got.keys() == whole.keys()
        for k, v in whole.items():
            assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(v, got[k], strict=True)), (n, k, v, got[k])
        after = {p: p.stat().st_mtime_ns for p in (tmp_path / "features").rglob("part-*") if "_batches" not in str(p)}
        if n == 1:  # months before the new bars are not written again
            assert {p for p in before if after.get(p) != before[p]} == {p for p in before if "2025-05" in str(p) or "2025-06" in str(p)}
        if n == 4:
            assert after == before
    again = spark.createDataFrame(files[3], BARS)
    make().apply(again, 3)
    assert {(r["instrument_id"], r["date"]): [r[c] for c in names] for r in make().read().collect()}.keys() == whole.keys()
