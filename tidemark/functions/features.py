"""Features: definitions, their column names, and the registry that compiles them.

A family compiles either to a Column over the shared window, or (Wilder's smoothing) to increments that are smoothed in one
ordered pass afterwards. All families see the bars up to the row's date only. A family says how many bars before its own it looks at, so
that long series can be dealt to blocks (``operators.blocks``).
"""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from decimal import Decimal
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import InvalidArgument
from tidemark.functions.scalars import ratio
from tidemark.functions.windows import DATE, ID, along, last_rows, series
from tidemark.operators.blocks import BLOCK, OWN, deal

BANDS = ("upper", "middle", "lower")


def encode(value: object) -> str:
    """A parameter's value in a column name: the same text for equal values, different texts for all others.

    Numbers are bare, strings quoted, other scalars have a mark before them, and each kind of container has brackets of its own.
    """
    if value is None or isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int | float | Decimal):
        d = Decimal(str(value))
        if not d.is_finite():
            raise InvalidArgument(f"not a finite number: {value}")
        text = format(d.normalize(), "f")
        return "0" if text == "-0" else text
    if isinstance(value, dt.date | dt.datetime):
        return f"{type(value).__name__}@{value.isoformat()}"
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise InvalidArgument("keys of a parameter must be strings")
        return "{" + ",".join(f"{encode(k)}:{encode(value[k])}" for k in sorted(value)) + "}"
    for kind, (left, right) in _BRACKETS.items():
        if type(value) is kind:
            parts = map(encode, value)
            return left + ",".join(sorted(parts) if kind in (set, frozenset) else parts) + right
    raise InvalidArgument(f"parameters can't hold {type(value).__name__}")


_BRACKETS = {list: ("[", "]"), tuple: ("(", ")"), set: ("<", ">"), frozenset: ("<<", ">>")}
#: Strings that need no quotes in a name: words that no other value is written as.
_BARE = re.compile(r"(?!(?:none|true|false)$)[a-z]+")


@dataclass(frozen=True)
class Feature:
    """A family with parameters, such as ``Feature("sma", {"window": 20})``."""

    family: str
    params: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        for k in self.params:
            if not isinstance(k, str) or not k or "_" in k:
                raise InvalidArgument(f"a parameter's key must be a word without an underscore, not {k!r}")

    @property
    def name(self) -> str:
        """Keys hold no underscore and values are told apart, so two features have one name only if they are equal."""
        plain = lambda v: v if isinstance(v, str) and _BARE.fullmatch(v) else encode(v)
        return "_".join([self.family.strip().lower(), *(f"{k}_{plain(self.params[k])}" for k in sorted(self.params))])


def positive(params: dict, key: str, default: int) -> int:
    n = params.get(key, default)
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise InvalidArgument(f"{key} must be a positive integer, not {n!r}")
    return n


def _enough(n: int, c: Column) -> Column:
    return F.when(F.row_number().over(series()) >= n, c)


def _return(params: dict) -> Column:
    base = F.lag("close", positive(params, "window", 1)).over(series())
    return ratio(F.col("close"), base) - 1


def _sma(params: dict) -> Column:
    n = positive(params, "window", 20)
    return _enough(n, F.avg("close").over(last_rows(n)))


def _bollinger(params: dict) -> Column:
    n, k, band = positive(params, "window", 20), params.get("k", 2), params.get("band", "middle")
    if isinstance(k, bool) or not isinstance(k, int | Decimal) or k <= 0:
        raise InvalidArgument(f"k must be a positive integer or Decimal, not {k!r}")
    if band not in BANDS:
        raise InvalidArgument(f"band must be one of {BANDS}")
    mean, spread = F.avg("close").over(last_rows(n)), F.stddev_pop("close").over(last_rows(n)) * float(k)
    return _enough(n, {"upper": mean + spread, "middle": mean, "lower": mean - spread}[band])


def true_range() -> Column:
    """From the second bar of a series on."""
    before = F.lag("close").over(series())
    return F.when(before.isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)))


@dataclass(frozen=True)
class Smoothed:
    """Increments to smooth by Wilder's rule over ``window`` bars, and what the smoothed values give."""

    window: int
    increments: tuple[Column, ...]
    close_out: Callable[..., np.ndarray]


@dataclass(frozen=True)
class Stepped:
    """A calculator of the user: ``begin`` makes the state of a series, ``step`` gives the values of its next rows from the state and the inputs.

    It sees each series in order, in as many pieces as batches hold of it, and changes the state in place; NaN stands for null on both sides.
    """

    inputs: tuple[Column, ...]
    begin: Callable[[], object]
    step: Callable[..., np.ndarray]


def _rsi_value(gain: np.ndarray, loss: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        out = 100.0 * gain / (gain + loss)
    out = np.where(gain == 0, 0.0, out)
    out = np.where(loss == 0, 100.0, out)
    return np.where((gain == 0) & (loss == 0), 50.0, out)


def _rsi(params: dict) -> Smoothed:
    step = F.col("close") - F.lag("close").over(series())
    some = lambda x: F.when(step.isNotNull(), F.greatest(x, F.lit(0.0)))  # greatest() skips null
    return Smoothed(positive(params, "window", 14), (some(step), some(-step)), _rsi_value)


def _atr(params: dict) -> Smoothed:
    return Smoothed(positive(params, "window", 14), (true_range(),), lambda x: x)


Compiled = Column | Smoothed | Stepped


class Registry:
    """Families by normalised name: windowed columns, smoothed increments, or calculators that go along a series."""

    def __init__(self) -> None:
        self._families: dict[str, tuple[Callable[[dict], Compiled], Callable[[dict], int] | None]] = {}

    def register(self, family: str, compile_: Callable[[dict], Compiled], lookback: Callable[[dict], int] | None = None) -> None:
        """``lookback``: how many bars before its own a feature of these parameters looks at. Without it the family can't go over blocks of a series."""
        key = family.strip().lower()
        if key in self._families:
            raise InvalidArgument(f"family {key} is registered already")
        self._families[key] = compile_, lookback

    def compile(self, feature: Feature) -> Compiled:
        return self._families[feature.family.strip().lower()][0](feature.params)

    def lookback(self, feature: Feature) -> int:
        look = self._families[feature.family.strip().lower()][1]
        if look is None:
            raise InvalidArgument(f"family {feature.family!r} doesn't say how many bars it looks back at")
        return look(feature.params)

    def families(self) -> list[str]:
        return sorted(self._families)


def default_registry() -> Registry:
    out = Registry()
    before = lambda default, own: lambda p: positive(p, "window", default) - own
    out.register("return", _return, before(1, 0))
    out.register("sma", _sma, before(20, 1))
    out.register("bollinger_bands", _bollinger, before(20, 1))
    out.register("rsi", _rsi, lambda p: 1)
    out.register("atr", _atr, lambda p: 1)
    return out


def wilder(x: np.ndarray, n: int, state: list) -> np.ndarray:
    """Smoothed values of increments ``x``, going on from ``state`` (count and sum so far, smoothed value) of the series.

    The seed is the mean of the first n increments; then (previous * (n - 1) + x) / n, folded in just this order of operations: a closed
    form over blocks would differ from the rule in the last bits. The fold takes about 0.1 microseconds a row.
    """
    out = np.full(len(x), np.nan)
    at = np.flatnonzero(~np.isnan(x))  # the series' first bar has no increment
    v = x[at].tolist()
    count, total, value = state
    need = n - count
    for y in v[: max(0, need)]:
        total += y
    if len(v) >= need > 0:
        value = total / n
        out[at[need - 1]] = value
    if len(v) > max(0, need):
        rest = list(accumulate(v[max(0, need) :], lambda before, y: (before * (n - 1) + y) / n, initial=value))
        out[at[max(0, need) :]] = rest[1:]
        value = rest[-1]
    state[:] = [count + len(v), total, value]
    return out


def add_features(
    bars: DataFrame,
    features: list[Feature],
    registry: Registry | None = None,
    extra: dict[str, Column] | Callable[[], dict[str, Column]] | None = None,
    order: str = DATE,
    rows_per_block: int | None = None,
    ahead: int = 0,
) -> DataFrame:
    """``bars`` with a column for each feature, in one shuffle by instrument.

    ``extra``: further columns over the same window (labels), or what makes them. ``order``: the column that bars go by, a date or a timestamp.
    Features on smoothed values follow in one streamed pass over the partitions, which the window has left sorted by instrument and
    order; it holds a batch of rows and one state.

    With ``rows_per_block`` longer series are dealt to blocks of about so many rows with halos, for ``ahead`` bars after a row too, and smoothing is carried
    from block to block (``_carried``). Windowed columns are the same; smoothed ones may differ in the last bits (relatively by less than
    1e-12), since what a block starts from is then a sum in another order.
    """
    registry = registry or default_registry()
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise InvalidArgument("two features have the same column name")
    keys = (ID,)
    if rows_per_block is not None:
        keys = (ID, BLOCK)
        bars = deal(bars, rows_per_block, max([1, *map(registry.lookback, features)]), ahead, order)
    with along(keys, order):
        made = [(f.name, registry.compile(f)) for f in features]
        direct = {n: c for n, c in made if isinstance(c, Column)} | (extra() if callable(extra) else extra or {})
        smoothed = [(n, s) for n, s in made if isinstance(s, Smoothed)]
        stepped = [(n, s) for n, s in made if isinstance(s, Stepped)]
        if stepped and rows_per_block is not None:
            raise InvalidArgument(f"{stepped[0][0]} goes along whole series, not over blocks")
        steps = {f"_inc{i}_{j}": c for i, (_, s) in enumerate(smoothed) for j, c in enumerate(s.increments)}
        steps |= {f"_in{i}_{j}": c for i, (_, s) in enumerate(stepped) for j, c in enumerate(s.inputs)}
        place = {"_place": F.row_number().over(series())} if smoothed or stepped else {}  # so that there is a window whatever the increments are: it brings each series' rows together
        out = bars.withColumns(direct | steps | place)
        if rows_per_block is not None:
            out = out.where(OWN).drop(OWN)
            if smoothed:
                windows = {f"_inc{i}_{j}": s.window for i, (_, s) in enumerate(smoothed) for j in range(len(s.increments))}
                out = _carried(out, windows, order).withColumns(place)
    if smoothed or stepped:
        out = _smooth(out, smoothed, keys, order, stepped=stepped)
    return defined(out.drop(BLOCK), features)


def defined(rows: DataFrame, features: list[Feature]) -> DataFrame:
    """``rows`` whose feature columns say how they are defined, in their metadata: selections keep it, and so does Parquet."""
    for f in features:
        rows = rows.withMetadata(f.name, {"feature": json.dumps([f.family.strip().lower(), {k: encode(v) for k, v in sorted(f.params.items())}])})
    return rows


def _smooth(rows: DataFrame, smoothed: list[tuple[str, Smoothed]], keys: tuple[str, ...], order: str, left: str | None = None, stepped: list[tuple[str, Stepped]] | None = None) -> DataFrame:
    """Fold the increments of each series, from nothing or from the state that is beside them (``_state...``). With the state (``_left...``) that a row leaves where column ``left`` says so."""
    inputs = [f"_inc{i}_{j}" for i, (_, s) in enumerate(smoothed) for j in range(len(s.increments))]
    # States go to and from the workers as numbers: arrays would be made one by one for each row.
    begins = {c: [f"_state{c}_{k}" for k in range(3)] for c in inputs if f"_state{c}" in rows.columns}
    rows = rows.withColumns({x: F.col(f"_state{c}")[k] for c, xs in begins.items() for k, x in enumerate(xs)}).drop(*[f"_state{c}" for c in begins])
    leaves = {c: [f"_left{c}_{k}" for k in range(3)] for c in inputs} if left else {}
    stepped = stepped or []
    own = {f"_in{i}_{j}" for i, (_, s) in enumerate(stepped) for j in range(len(s.inputs))}
    kept = [c for c in rows.columns if c not in {*inputs, *own, *[x for xs in begins.values() for x in xs], "_place", left}]
    names = [n for n, _ in [*smoothed, *stepped]]
    schema = T.StructType([rows.schema[c] for c in kept] + [T.StructField(n, T.DoubleType()) for n in [*names, *[x for xs in leaves.values() for x in xs]]])
    # What goes to the workers: no Columns.
    plan = [(n, s.window, [f"_inc{i}_{j}" for j in range(len(s.increments))], s.close_out) for i, (n, s) in enumerate(smoothed)]
    walks = [(n, [f"_in{i}_{j}" for j in range(len(s.inputs))], s.begin, s.step) for i, (n, s) in enumerate(stepped)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, states, walking = None, {}, {}
        for pdf in batches:
            ids = list(zip(*(pdf[k].to_numpy() for k in keys), strict=True))
            change = np.zeros(len(pdf), bool)
            for k in keys:
                v = pdf[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            cuts = np.flatnonzero(np.concatenate([[True], change[1:]])) if len(ids) else np.zeros(0, int)
            result = {n: np.full(len(pdf), np.nan) for n in names}
            ends = pdf[left].to_numpy(bool) if left else None
            after = {x: np.full(len(pdf), np.nan) for xs in leaves.values() for x in xs}
            columns = {c: pdf[c].to_numpy(float) for c in [*inputs, *own, *[x for xs in begins.values() for x in xs]]}
            for a, b in zip(cuts, [*cuts[1:], len(ids)], strict=True):
                if ids[a] != key:
                    key = ids[a]
                    walking = {n: begin() for n, _, begin, _ in walks}
                    found = {c: [float(columns[x][a]) for x in xs] for c, xs in begins.items()}
                    states = {c: [int(found[c][0]), *found[c][1:]] if c in found and not np.isnan(found[c][0]) else [0, 0.0, 0.0] for c in inputs}
                for n, cols, _, step in walks:
                    result[n][a:b] = step(walking[n], *[columns[c][a:b] for c in cols])
                for n, window, cols, close_out in plan:
                    before = {c: tuple(states[c]) for c in cols} if left else {}
                    parts = [wilder(columns[c][a:b], window, states[c]) for c in cols]
                    for c, v in zip(cols, parts, strict=True) if left else ():
                        at = np.flatnonzero(ends[a:b])
                        for x, y in zip(leaves[c], leaving(columns[c][a:b], v, window, *before[c]), strict=True):
                            after[x][a + at] = y[at]
                    result[n][a:b] = close_out(*parts)
                    result[n][a:b][np.isnan(parts[0])] = np.nan
            yield pdf[kept].assign(**result, **after)

    done = rows.sortWithinPartitions(*keys, order).mapInPandas(run, schema)
    done = done.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in names} | {f"_left{c}": F.when(F.col(xs[0]).isNotNull() & ~F.isnan(xs[0]), F.array(*xs)) for c, xs in leaves.items()})
    return done.drop(*[x for xs in leaves.values() for x in xs])


def _carried(rows: DataFrame, windows: dict[str, int], order: str) -> DataFrame:
    """``rows`` of blocks with the state (``_state...``: count, sum, value) in which the smoothing of each increment enters their block.

    Over the m increments of a block Wilder's rule is the affine map value * a^m + sum of x_i / n * a^(m - i), with a = (n - 1) / n. The maps
    are one aggregation; an instrument's maps, one row a block, are then applied one after the other. Only they are shuffled and joined back.
    """
    own = series()
    place = {f"_nth{c}": F.count(c).over(own) for c in windows} | {f"_all{c}": F.count(c).over(Window.partitionBy(ID, BLOCK)) for c in windows}
    marked = rows.withColumns(place)
    aggs = []
    for c, n in windows.items():
        a, there = (n - 1) / n, F.col(c).isNotNull()
        pull = F.when(there, F.col(c) / n * F.pow(F.lit(a), F.col(f"_all{c}") - F.col(f"_nth{c}")))
        early = F.when(there & (F.col(f"_nth{c}") <= n), F.struct(F.col(f"_nth{c}").alias("i"), F.col(c).alias("x")))  # what may go into the seed
        aggs += [F.count(c).alias(f"m{c}"), F.coalesce(F.sum(pull), F.lit(0.0)).alias(f"b{c}"), F.transform(F.array_sort(F.collect_list(early)), lambda e: e["x"]).alias(f"f{c}")]
    maps = marked.groupBy(ID, BLOCK).agg(*aggs)
    schema = T.StructType([rows.schema[ID], rows.schema[BLOCK], *[T.StructField(f"_state{c}", T.ArrayType(T.DoubleType())) for c in windows]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BLOCK, ignore_index=True)
        out = {ID: pdf[ID], BLOCK: pdf[BLOCK]}
        for c, n in windows.items():
            out[f"_state{c}"] = list(entering(pdf[f"m{c}"].tolist(), pdf[f"b{c}"].tolist(), pdf[f"f{c}"].tolist(), n))
        return pd.DataFrame(out)

    states = maps.groupBy(ID).applyInPandas(run, schema)
    key = [F.col(k).alias(f"{k}_s") for k in (ID, BLOCK)]
    joined = rows.join(states.select(*key, *[f"_state{c}" for c in windows]), (F.col(ID) == F.col(f"{ID}_s")) & (F.col(BLOCK) == F.col(f"{BLOCK}_s")), "left")
    return joined.drop(f"{ID}_s", f"{BLOCK}_s")


def leaving(x: np.ndarray, smoothed: np.ndarray, n: int, count: int, total: float, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The state (count, sum, value) after each row, from the increments, their smoothed values, and the state before the first."""
    there = ~np.isnan(x)
    counts = count + np.cumsum(there)
    sums = total + np.cumsum(np.where(there & (counts <= n), x, 0.0))
    last = np.maximum.accumulate(np.where(np.isnan(smoothed), -1, np.arange(len(x))))
    values = np.where(last < 0, value, smoothed[last])
    return counts.astype(float), sums, values


def add_from(bars: DataFrame, features: list[Feature], since: str, end: str, registry: Registry | None = None, order: str = DATE, states: DataFrame | None = None) -> DataFrame:
    """Instrument, order and features of the rows of ``bars`` from ``since`` (a column) on; those before are only looked back at.

    ``states``: for an instrument the state in which smoothing enters its first such row, by the name of the increment, as a former call has left it in the row before
    (``_left...``, see ``state_columns``); without one it begins there. The result has the states that rows leave where column ``end`` says so; others have null.
    """
    registry = registry or default_registry()
    with along((ID,), order):
        made = [(f.name, registry.compile(f)) for f in features]
        smoothed = [(n, s) for n, s in made if isinstance(s, Smoothed)]
        if any(isinstance(s, Stepped) for _, s in made):
            raise InvalidArgument("calculators go along whole series, not from a row on")
        steps = {f"_inc{i}_{j}": c for i, (_, s) in enumerate(smoothed) for j, c in enumerate(s.increments)}
        direct = {n: c for n, c in made if isinstance(c, Column)}
        out = bars.withColumns(direct | steps).where(F.col(order) >= F.col(since)).select(ID, order, *direct, *steps, *([end] if smoothed else []))
        if smoothed:
            named = {c: f"_state{c.removeprefix('_left')}" for c in state_columns(features, registry)}
            if states is None:
                out = out.withColumns({n: F.lit(None).cast("array<double>") for n in named.values()})
            else:
                own = states.select(F.col(ID).alias("_sid"), *[F.col(c).alias(n) for c, n in named.items()])
                out = out.join(own, F.col(ID) == F.col("_sid"), "left").drop("_sid")
            out = out.withColumn("_place", F.row_number().over(series()))
    return _smooth(out, smoothed, (ID,), order, left=end) if smoothed else out


def state_columns(features: list[Feature], registry: Registry | None = None) -> list[str]:
    """Columns of the states that ``add_from`` leaves: one for each increment of each smoothed feature."""
    registry = registry or default_registry()
    made = [registry.compile(f) for f in features]
    return [f"_left_inc{i}_{j}" for i, s in enumerate(x for x in made if isinstance(x, Smoothed)) for j in range(len(s.increments))]


def entering(counts: list[int], pulls: list[float], firsts: list[np.ndarray], n: int) -> Iterator[list[float]]:
    """The state (count, sum, value) before each block, from its number of increments, what they pull to, and its first n increments.

    Increments that still go into the seed are taken out of the block's pull: they are among its first n.
    """
    a = (n - 1) / n
    count, total, value = 0, 0.0, 0.0
    for m, pull, first in zip(counts, pulls, firsts, strict=True):
        yield [float(count), total, value]
        seed = [float(x) for x in first[: max(0, min(n - count, m))]]
        for x in seed:
            total += x
        if seed and count + len(seed) == n:
            value = total / n
        if count + m > n or count >= n:
            pull -= sum(x / n * a ** (m - i) for i, x in enumerate(seed, 1))
            value = value * a ** (m - len(seed)) + pull
        count += m
