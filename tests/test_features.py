"""Features, labels and adjusted prices. Expected numbers are fixed values: the golden cases that FIXTURES.md lists with their sources."""

import datetime as dt
from decimal import Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.features import Feature, Smoothed, add_features, default_registry, encode, wilder
from tidemark.operators.adjust import adjust_bars
from tidemark.operators.targets import Target, add_target
from tidemark.plans import dataset

DAY0 = dt.date(2026, 1, 1)
BARS = "instrument_id long, date date, open double, high double, low double, close double, volume double"
ACTIONS = "instrument_id long, action_type string, execution_date date, value double"


def day(i):
    return DAY0 + dt.timedelta(days=i)


def bars(spark, closes, spread=0.0, ident=1, volumes=None):
    return spark.createDataFrame(
        [(ident, day(i), float(c), float(c) + spread, float(c) - spread, float(c), float(volumes[i] if volumes else 1000)) for i, c in enumerate(closes)], BARS
    )


def hlc(spark, rows):
    return spark.createDataFrame([(1, day(i), float(c), float(h), float(lo), float(c), 1.0) for i, (h, lo, c) in enumerate(rows)], BARS)


def values(df, column):
    return [r[column] for r in df.orderBy("date").collect()]


def actions(spark, *rows):
    return spark.createDataFrame([(1, kind, day(i), float(v)) for kind, i, v in rows], ACTIONS)


@pytest.mark.parametrize(
    ("closes", "expected"),
    [
        ([100, 104, 102, 108], 800 / 9),
        ([100, 104, 102, 106, 103], 600 / 13),
        ([1, 2, 3, 4], 100.0),
        ([4, 3, 2, 1], 0.0),
        ([5, 5, 5, 5], 50.0),
        ([5, 6], None),
    ],
)
def test_rsi(spark, closes, expected):
    f = Feature("rsi", {"window": 2})
    got = values(add_features(bars(spark, closes), [f]), f.name)[-1]
    assert got == (expected if expected is None else pytest.approx(expected))


@pytest.mark.parametrize(
    ("n", "rows", "expected"),
    [
        (1, [(100, 100, 100), (110, 90, 101)], 20),
        (1, [(100, 100, 100), (110, 105, 107)], 10),
        (1, [(100, 100, 100), (92, 85, 90)], 15),
        (2, [(102, 98, 100), (106, 100, 104), (103, 96, 98)], 7),
        (2, [(102, 98, 100), (106, 100, 104), (103, 96, 98), (108, 102, 105)], 8.5),
    ],
)
def test_atr(spark, n, rows, expected):
    f = Feature("atr", {"window": n})
    assert values(add_features(hlc(spark, rows), [f]), f.name)[-1] == pytest.approx(expected)


def test_bollinger(spark):
    fs = [Feature("bollinger_bands", {"window": 4, "k": 2, "band": b}) for b in ("lower", "middle", "upper")]
    row = add_features(bars(spark, [10, 20, 10, 20]), fs).orderBy("date").collect()[-1]
    assert [row[f.name] for f in fs] == pytest.approx([5, 15, 25])


def test_five_families_together(spark):
    fs = [Feature("return", {"window": 5}), Feature("sma", {"window": 5}), Feature("rsi"), Feature("atr"), Feature("bollinger_bands", {"window": 5})]
    row = add_features(bars(spark, [100 + 2 * i for i in range(20)], spread=2), fs).orderBy("date").collect()[-1]
    assert [row["rsi"], row["atr"], row["bollinger_bands_window_5"]] == pytest.approx([100, 4, 134])


def test_smoothing_goes_on_over_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        closes = list(np.random.default_rng(1).uniform(50, 150, 40))
        two = bars(spark, closes).union(bars(spark, closes[::-1], ident=2))
        got = {(r["instrument_id"], r["date"]): r["rsi"] for r in add_features(two, [Feature("rsi")]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for ident, series in ((1, closes), (2, closes[::-1])):
        step = np.diff(series)
        g, lo = np.maximum(step, 0), np.maximum(-step, 0)
        a, b = g[:14].mean(), lo[:14].mean()
        for i in range(14, 40):
            if i > 14:
                a, b = (a * 13 + g[i - 1]) / 14, (b * 13 + lo[i - 1]) / 14
            assert got[ident, day(i)] == pytest.approx(100 * a / (a + b))
        assert got[ident, day(13)] is None


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 1e6), max_size=30), st.integers(1, 8), st.integers(0, 30))
def test_wilder_state_is_all_it_needs(xs, n, cut):
    x = np.array(xs)
    whole, state = wilder(x, n, [0, 0.0, 0.0]), [0, 0.0, 0.0]
    parts = np.concatenate([wilder(x[:cut], n, state), wilder(x[cut:], n, state)])
    assert np.array_equal(whole, parts, equal_nan=True)


def test_names_and_arguments():
    assert Feature("bollinger_bands", {"window": 20, "band": "upper", "k": 2}).name == "bollinger_bands_band_upper_k_2_window_20"
    assert encode(Decimal("2")) == encode(2) == "2" and encode(True) == "true" and encode([1, None]) == "[1,none]"
    with pytest.raises(InvalidArgument):
        encode(object())
    r = default_registry()
    for bad in (0, -1, True, 1.5):
        with pytest.raises(InvalidArgument):
            r.compile(Feature("sma", {"window": bad}))
    with pytest.raises(KeyError):
        r.compile(Feature("macd"))
    with pytest.raises(InvalidArgument):
        r.register(" SMA ", lambda p: None)
    with pytest.raises(InvalidArgument):
        Target("Total_return", 5)


def test_names_tell_features_apart():
    values = ["x", "x_b_1", "true", True, "1", 1, 2, "2", None, "none", "None", "", " x", '"x"', [1], (1,), {1}, frozenset({1}), ["1"], [], (), set(), {}, {"a": 1}, {"a": "1"}, {"a:1": 1}, [[1], 2], [[1, 2]], dt.date(2024, 1, 1), "2024-01-01"]
    names = [Feature("f", {"a": v}).name for v in values]
    assert len(set(names)) == len(values)
    assert Feature("f", {"a": "x_b_1"}).name != Feature("f", {"a": "x", "b": 1}).name
    assert Feature("f", {"a": {"p": 1, "q": 2}}).name == Feature("f", {"a": {"q": Decimal("2.0"), "p": 1}}).name
    for key in ("a_b", "", 1):
        with pytest.raises(InvalidArgument):
            Feature("f", {key: 1})
    with pytest.raises(InvalidArgument):
        encode({1: 2})


def test_smoothing_without_a_window(spark):
    """Increments of a family that needs no window: each instrument's rows still come together."""
    r = default_registry()
    r.register("level", lambda p: Smoothed(2, (F.col("close"),), lambda x: x))
    rows = [(i, dt.date(2026, 1, d), 1.0, 1.0, 1.0, float(d), 1.0) for d in range(1, 6) for i in (1, 2, 3)]
    got = add_features(spark.createDataFrame(rows, BARS).repartition(4), [Feature("level")], r)
    assert "_place" not in got.columns
    assert {tuple(x) for x in got.where("instrument_id = 2").select(F.day("date"), "level").collect()} == {(1, None), (2, 1.5), (3, 2.25), (4, 3.125), (5, 4.0625)}


def test_split_adjusted(spark):
    b = spark.createDataFrame([(1, day(0), 190.0, 210.0, 180.0, 200.0, 1000.0), (1, day(1), 100.0, 100.0, 100.0, 100.0, 2000.0)], BARS)
    first, second = adjust_bars(b, actions(spark, ("split", 1, 2))).orderBy("date").collect()
    assert [first[c] for c in ("open", "high", "low", "close", "volume")] == [95, 105, 90, 100, 2000]
    assert second["close"] == 100 and second["volume"] == 2000
    out = adjust_bars(bars(spark, [600, 300, 110], volumes=[100, 200, 600]), actions(spark, ("split", 1, 2), ("split", 2, 3)))
    assert values(out, "close") == pytest.approx([100, 100, 110]) and values(out, "volume") == pytest.approx([600] * 3)
    with pytest.raises(Exception, match="split ratio"):
        adjust_bars(b, actions(spark, ("split", 1, 0))).collect()


@pytest.mark.parametrize(
    ("closes", "events", "h", "expected"),
    [
        ([200, 100], [("split", 1, 2)], 1, 0),
        ([50, 100], [("split", 1, 0.5)], 1, 0),
        ([100, 97, 97], [("dividend", 1, 3)], 2, 0),
        ([100, 98, 97, 97], [("dividend", 1, 2), ("dividend", 2, 3)], 3, 100 / 98 - 1),
        ([200, 196, 98, 98], [("dividend", 1, 4), ("split", 2, 2)], 3, 0),
        ([100, 100], [("dividend", 0, 5)], 1, 0),
        ([100, 95], [("dividend", 1, 5)], 1, 0),
        ([100, 0, 100], [("dividend", 1, 5)], 2, None),
    ],
)
def test_total_return(spark, closes, events, h, expected):
    got = values(add_target(bars(spark, closes), Target("total_return", h), actions(spark, *events)), "target")[0]
    assert got == (expected if expected is None else pytest.approx(expected, abs=1e-12))


def test_ex_date_without_a_bar(spark):
    b = bars(spark, [100, 100, 100, 100]).where("day(date) <> 2")
    assert values(add_target(b, Target("total_return", 2), actions(spark, ("dividend", 1, 5))), "target")[0] is None


def test_dataset_counters_and_inference(spark):
    fs = [Feature("return", {"window": 1}), Feature("sma", {"window": 5}), Feature("rsi", {"window": 14})]
    ds = dataset.build(bars(spark, [100 + i for i in range(30)]), fs, Target("forward_return", 5))
    c = ds.drop_counters().first()
    assert (ds.rows.count(), c["dropped_features"], c["dropped_target"]) == (11, 14, 5)
    b, sma = bars(spark, [1, 2, 3, 4, 5]), [Feature("sma", {"window": 2})]
    labelled = dataset.build(b, sma, Target("forward_return", 1)).rows
    assert [r[1].day for r in labelled.orderBy("observation_date").collect()] == [2, 3, 4]
    assert [r[1].day for r in dataset.inference(b, sma).orderBy("observation_date").collect()] == [2, 3, 4, 5]


def test_features_do_not_see_the_future(spark):
    fs = [Feature("return"), Feature("sma", {"window": 3}), Feature("rsi", {"window": 3}), Feature("atr", {"window": 3}), Feature("bollinger_bands", {"window": 3})]
    closes = [100, 103, 99, 105, 104, 108, 101, 107]
    names = [f.name for f in fs]
    a = add_features(bars(spark, closes), fs).orderBy("date").select(*names).collect()
    b = add_features(bars(spark, [*closes[:5], 1, 2, 3]), fs).orderBy("date").select(*names).collect()
    assert a[:5] == b[:5] and a[5:] != b[5:]
