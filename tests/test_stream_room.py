"""Features that follow a stream need room for a group of partitions beside the tables, whatever their number, and are the same for it."""

import datetime as dt
import time

import pytest

from tests.test_features import BARS
from tidemark.files import size
from tidemark.functions.features import Feature, add_features
from tidemark.operators import store
from tidemark.operators.store import KeyedTable, grouped
from tidemark.streaming.bars import bar_table
from tidemark.streaming.features import FeatureStream

OWN = [Feature("return", {"window": 3}), Feature("sma", {"window": 40}), Feature("rsi", {"window": 14}), Feature("atr", {"window": 5})]
NAMES = [f.name for f in OWN]


def bars(spark, days, instruments=(1, 2), more=0.0):
    price = lambda i, d: 100.0 + i + (d * 7919 % 31) - 15 + more
    rows = [(i, dt.date(2024, 12, 1) + dt.timedelta(days=d), p, p + 1, p - 1, p, 1.0) for i in instruments for d in days for p in [price(i, d)]]
    return spark.createDataFrame(rows, BARS)


def stream(spark, at, bars_by="month", features_by="month"):
    schema = spark.createDataFrame([], BARS).schema
    return FeatureStream(spark, f"{at}/features", bar_table(spark, f"{at}/bars", schema, part=bars_by), OWN, part=features_by)


def is_whole(s):
    found = lambda rows: {(r["instrument_id"], r["date"]): [r[c] for c in NAMES] for r in rows.collect()}
    assert found(s.read()) == found(add_features(s.bars.read(), OWN))  # to the last bit


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}


def test_what_a_batch_leaves(spark, tmp_path):
    """States of an instrument's last bar in a month, no copy of the batch or of its features, and no shuffled rows."""
    s, before = stream(spark, tmp_path), shuffle_files(spark)
    s.apply(bars(spark, range(150)), 0)
    end = time.time() + 20  # files are removed beside the job
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    months, rows = 5, s.table.read()
    assert rows.count() == 300 and {c: rows.where(f"{c} is not null").count() for c in s.kept} == dict.fromkeys(s.kept, 2 * months)
    assert size(spark, f"{s.bars.path}/_batches") == 0 and size(spark, f"{s.table.path}/_batches") < size(spark, s.table.path) / 4
    assert rows.where("instrument_id = 1").count() == 150
    is_whole(s)


@pytest.mark.parametrize("bars_by,features_by", [("month", "month"), ("month", "year"), ("year", "month")])
def test_groups(spark, tmp_path, monkeypatch, bars_by, features_by):
    """One partition after the other, with late and revised bars, and a batch that breaks off between two of them and comes again."""
    monkeypatch.setattr(store, "GROUP", 1)
    monkeypatch.setattr(store, "GROUPS", 1 << 40)
    s, real, writes = stream(spark, tmp_path, bars_by, features_by), KeyedTable.overwrite, []
    s.apply(bars(spark, [d for d in range(130) if d not in (3, 50)]), 0)
    is_whole(s)

    def breaks(self, rows):
        if self.path == s.table.path:
            writes.append(self.path)
            if len(writes) == 2:
                raise RuntimeError("disk is full")
        real(self, rows)

    monkeypatch.setattr(KeyedTable, "overwrite", breaks)
    late = bars(spark, [3, 50], [1]).unionByName(bars(spark, [70], [2], 4.0)).unionByName(bars(spark, [20, 125], [3]))
    with pytest.raises(RuntimeError, match="disk is full"):
        s.apply(late, 1)
    s.apply(late, 1)
    assert len(writes) > 3 or "year" in (bars_by, features_by)
    is_whole(s)
    again = len(writes)
    s.apply(bars(spark, [70], [2], 4.0), 2)  # nothing new
    assert len(writes) == again
    is_whole(s)


def test_sizes_of_groups():
    mb = 1 << 20
    assert grouped({}) == [] and grouped({"b": 3 * mb, "a": 1, "c": 12 * mb}) == [["a", "b", "c"]]
    assert grouped({"1": 20 * mb, "2": 15 * mb, "3": 2 * mb}) == [["1"], ["2"], ["3"]]
    many = grouped({f"{i:04d}": 10 * mb for i in range(800)})
    assert len(many) == 8 and sum(many, []) == [f"{i:04d}" for i in range(800)]
