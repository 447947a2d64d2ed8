"""Series in blocks give what whole series give, and no task gets more than a block and its halo."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions.features import Feature, Smoothed, add_features, default_registry, entering, wilder
from tidemark.operators.blocks import BLOCK, deal
from tidemark.operators.targets import Target, add_target
from tidemark.plans import dataset

SCHEMA = "instrument_id long, ts timestamp, open double, high double, low double, close double, volume double"
FEATURES = [
    Feature("return", {"window": 7}), Feature("sma", {"window": 20}), Feature("rsi", {"window": 14}), Feature("atr", {"window": 5}),
    *[Feature("bollinger_bands", {"window": 15, "k": 2, "band": b}) for b in ("upper", "lower")],
]
NAMES = [f.name for f in FEATURES]


def bars_of(instrument, n, seed, step=lambda rng, i: rng.choice([1, 1, 1, 60, 3600, 86_400])):
    """Bars at uneven times: bursts of seconds, gaps of days."""
    rng, at, price, out = random.Random(seed), dt.datetime(2020, 1, 1), 100.0, []
    for i in range(n):
        at += dt.timedelta(seconds=step(rng, i))
        price = max(1.0, price + rng.choice([-1.5, -1, 0, 0, 1, 1.25]))
        out.append((instrument, at, price, price + rng.random(), price - rng.random(), price + rng.choice([-0.25, 0.0, 0.25]), float(i)))
    return out


@pytest.fixture(scope="module")
def bars(spark):
    """One instrument has most rows; one has a burst of most of its rows in a second of microseconds; others are short."""
    burst = bars_of(2, 900, 2, lambda rng, i: 1e-6 if 100 < i < 800 else 50_000)
    rows = [*bars_of(1, 3000, 1), *burst, *bars_of(3, 5, 3), *bars_of(4, 1, 4), *bars_of(5, 64, 5), *bars_of(6, 65, 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def by_key(df):
    return {(r["instrument_id"], r["ts"]): r.asDict() for r in df.collect()}


@pytest.mark.parametrize("rows", [20, 64, 1000, 10_000])
def test_blocks_give_the_same(bars, rows):
    whole, parts = by_key(add_features(bars, FEATURES, order="ts")), by_key(add_features(bars, FEATURES, order="ts", rows_per_block=rows))
    assert whole.keys() == parts.keys() and len(whole) == bars.count()
    for key, a in whole.items():
        b = parts[key]
        assert a.keys() == b.keys()
        for n in NAMES:
            assert (a[n] is None) == (b[n] is None), (key, n)
            if a[n] is not None:  # smoothed values to the stated tolerance, others exactly
                assert a[n] == b[n] if n.startswith(("return", "sma")) else abs(a[n] - b[n]) <= 1e-12 * max(1.0, abs(a[n])), (key, n)


def test_labels_over_blocks(bars):
    target = Target("forward_return", 9)
    assert by_key(add_target(bars, target, order="ts")) == by_key(add_target(bars, target, order="ts", rows_per_block=40))
    a = dataset.build(bars, FEATURES[:2], target, order="ts").rows.collect()
    b = dataset.build(bars, FEATURES[:2], target, order="ts", rows_per_block=50).rows.collect()
    assert sorted(a) == sorted(b) and len(a) > 3000


def test_no_task_gets_more_than_a_block_and_its_halo(bars):
    """One instrument with 3,000 of the rows: blocks of 100 hold some spans more, and 20 + 5 rows (and parts of spans) around them."""
    sizes = {(r[0], r[1]): r[2] for r in deal(bars, 100, 20, 5, "ts").groupBy("instrument_id", BLOCK).count().collect()}
    assert len([k for k in sizes if k[0] == 1]) > 10
    spread = deal(bars, 100, 20, 5, "ts").where("_own")
    own = {(r[0], r[1]): r[2] for r in spread.groupBy("instrument_id", BLOCK).count().collect()}
    assert sum(own.values()) == bars.count() and own.keys() == sizes.keys()
    widest = 800  # the burst is one span
    assert all(n <= 100 + widest for n in own.values()) and max(n for (i, _), n in own.items() if i == 1) < 250
    even = bars.sparkSession.createDataFrame(bars_of(9, 5000, 9, lambda rng, i: 60), SCHEMA)
    assert max(r["count"] for r in deal(even, 100, 20, 5, "ts").groupBy(BLOCK).count().collect()) <= 100 + 20 + 5 + 3 * 3


def test_halos_reach_over_small_blocks(bars):
    """Each own row finds as many rows before and after it as it would in the whole series."""
    from pyspark.sql import Window

    before, after = 40, 30
    w = Window.partitionBy("instrument_id").orderBy("ts")
    whole = {(r[0], r[1]): (min(r[2], before), min(r[3], after)) for r in bars.select("instrument_id", "ts", F.row_number().over(w) - 1, F.count("ts").over(w.rowsBetween(1, 2**31 - 1))).collect()}
    v = Window.partitionBy("instrument_id", BLOCK).orderBy("ts")
    dealt = deal(bars, 40, before, after, "ts")
    dealt = dealt.select("instrument_id", "ts", "_own", (F.row_number().over(v) - 1).alias("b"), F.count("ts").over(v.rowsBetween(1, 2**31 - 1)).alias("a")).where("_own")
    found = {(r[0], r[1]): (min(r["b"], before), min(r["a"], after)) for r in dealt.collect()}
    assert found == whole


def test_smoothing_enters_blocks_where_the_last_left_off():
    rng = np.random.default_rng(1)
    x = rng.random(400)
    for n in (1, 2, 14, 60):
        for cuts in ([100, 200, 300], [3, 5, 9, 50, 51], [399]):
            parts = np.split(x, cuts)
            a = (n - 1) / n
            pulls = [sum(v / n * a ** (len(p) - i) for i, v in enumerate(p, 1)) for p in parts]
            starts = list(entering([len(p) for p in parts], pulls, [p[:n] for p in parts], n))
            state = [0, 0.0, 0.0]
            for p, s in zip(parts, starts, strict=True):
                assert s[0] == state[0] and (state[0] < n or abs(s[2] - state[2]) < 1e-12) and (state[0] >= n or abs(s[1] - state[1]) < 1e-12)
                wilder(p, n, state)


def test_families_of_the_user_over_blocks(bars):
    r = default_registry()
    r.register("level", lambda p: Smoothed(3, (F.when(F.col("volume") % 5 != 0, F.col("close")),), lambda x: x), lambda p: 0)
    r.register("unsaid", lambda p: F.col("close"))
    level = [Feature("level")]
    a, b = by_key(add_features(bars, level, r, order="ts")), by_key(add_features(bars, level, r, order="ts", rows_per_block=30))
    for k, x in a.items():
        x, y = x["level"], b[k]["level"]
        assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-10)
    with pytest.raises(InvalidArgument):
        add_features(bars, [Feature("unsaid")], r, order="ts", rows_per_block=30)
    with pytest.raises(InvalidArgument):
        add_features(bars, [Feature("sma", {"window": 50})], order="ts", rows_per_block=30)


def test_blocks_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert add_features(empty, FEATURES, order="ts", rows_per_block=30).count() == 0
    out = add_features(empty, FEATURES, order="ts", rows_per_block=30)
    assert out.columns == add_features(empty, FEATURES, order="ts").columns and isinstance(out.schema["ts"].dataType, T.TimestampType)


def test_repeated_dates_raise(spark):
    rows = bars_of(1, 12, 1)
    again = spark.createDataFrame([*rows, rows[5]], SCHEMA)
    for make in (
        lambda df, **kw: dataset.build(df, FEATURES[:1], Target("forward_return", 1), order="ts", **kw).rows,
        lambda df, **kw: dataset.inference(df, FEATURES[:1], order="ts", **kw),
        lambda df, **kw: add_target(df, Target("forward_return", 1), order="ts", **kw),
    ):
        for more in ({}, {"rows_per_block": 7}):
            with pytest.raises(Exception, match="two bars of one instrument at 2020"):
                make(again, **more).collect()
    plain = spark.createDataFrame(rows, SCHEMA)
    dates = spark.createDataFrame([(1, rows[8][1]), (1, rows[9][1])], "instrument_id long, date timestamp")
    built = lambda d: dataset.build(plain, FEATURES[:1], Target("forward_return", 1), dates=d, order="ts").rows.collect()
    assert len(built(dates)) == 2
    with pytest.raises(Exception, match="requested twice"):
        built(dates.union(dates.limit(1)))
