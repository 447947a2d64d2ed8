"""Providers of bars as Spark data sources: plug one in by name, read it as a table or follow it as a stream.

A provider says which ranges of instruments it can be read in, and gives the bars of a range between two times as Arrow batches. Each range is an
input partition, so executors fetch them side by side and a lost one costs its ranges only. Conditions on instruments and times reach the
provider; what it can't apply exactly Spark applies again. Its errors come as ``ProviderFailed`` or ``RateLimited``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.errors import InvalidArgument, ProviderFailed, provider_error
from tidemark.functions.windows import ID

BARS = "instrument_id long, ts timestamp, open double, high double, low double, close double, volume double"
_ARROW = pa.schema([("instrument_id", pa.int64()), ("ts", pa.timestamp("us", "UTC")), *[(c, pa.float64()) for c in ("open", "high", "low", "close", "volume")]])
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Window:
    """What is asked for: instruments and times, both ends included; None is open."""

    low: int | None = None
    high: int | None = None
    start: dt.datetime | None = None
    end: dt.datetime | None = None

    def narrowed(self, column: str, at_least: object | None, at_most: object | None) -> Window:
        a, b = ("low", "high") if column == ID else ("start", "end")
        both = lambda f, x, y: y if x is None else x if y is None else f(x, y)
        return Window(**{**self.__dict__, a: both(max, getattr(self, a), at_least), b: both(min, getattr(self, b), at_most)})


class BarProvider(Protocol):
    """Travels to executors by pickling."""

    def ranges(self, parts: int) -> list[tuple[int, int]]:
        """Ranges of instrument ids, both ends included, that together hold all."""

    def bars(self, window: Window) -> Iterator[pa.RecordBatch]:
        """Bars in the window, with the columns of ``BARS``."""

    def newest(self) -> dt.datetime | None:
        """Up to when there are bars."""


def utc(t: dt.datetime) -> dt.datetime:
    return t.replace(tzinfo=dt.UTC) if t.tzinfo is None else t.astimezone(dt.UTC)


def _narrow(window: Window, f: Filter) -> tuple[Window, bool]:
    """The window within a condition, and whether it says all of it."""
    column = getattr(f, "attribute", ())
    if len(column) != 1 or column[0] not in (ID, "ts"):
        return window, False
    fit = (lambda v: v) if column[0] == ID else utc
    if isinstance(f, EqualTo):
        return window.narrowed(column[0], fit(f.value), fit(f.value)), True
    if isinstance(f, GreaterThanOrEqual | GreaterThan):
        return window.narrowed(column[0], fit(f.value), None), isinstance(f, GreaterThanOrEqual)
    if isinstance(f, LessThanOrEqual | LessThan):
        return window.narrowed(column[0], None, fit(f.value)), isinstance(f, LessThanOrEqual)
    if isinstance(f, In) and f.value and all(v is not None for v in f.value):
        values = [fit(v) for v in f.value]
        return window.narrowed(column[0], min(values), max(values)), False
    return window, False


@dataclass
class Part(InputPartition):
    window: Window


def _parts(provider: BarProvider, window: Window, parts: int) -> list[Part]:
    wanted = [window.narrowed(ID, a, b) for a, b in provider.ranges(parts)]
    return [Part(w) for w in wanted if w.low is None or w.high is None or w.low <= w.high] or [Part(window)]


def _fetch(provider: BarProvider, window: Window) -> Iterator[pa.RecordBatch]:
    try:
        for batch in provider.bars(window):
            yield pa.RecordBatch.from_arrays([batch[f.name].cast(f.type) for f in _ARROW], schema=_ARROW)
    except ProviderFailed:
        raise
    except Exception as e:
        raise provider_error(e, f"instruments {window.low} to {window.high}") from e


class _Reader(DataSourceReader):
    def __init__(self, provider: BarProvider, parts: int):
        self.provider, self.count, self.window = provider, parts, Window()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            self.window, exact = _narrow(self.window, f)
            if not exact:
                yield f

    def partitions(self) -> list[Part]:
        return _parts(self.provider, self.window, self.count)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _fetch(self.provider, partition.window)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the bars after the last offset up to the newest one."""

    def __init__(self, provider: BarProvider, parts: int):
        self.provider, self.count = provider, parts

    def initialOffset(self) -> dict:  # noqa: N802
        return {"until": ""}

    def latestOffset(self, *_: object) -> dict:  # noqa: N802
        newest = self.provider.newest()
        return {"until": "" if newest is None else utc(newest).isoformat()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        if not end["until"]:
            return []
        after = dt.datetime.fromisoformat(start["until"]) + dt.timedelta(microseconds=1) if start["until"] else None
        return _parts(self.provider, Window(start=after, end=dt.datetime.fromisoformat(end["until"])), self.count)

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        return _fetch(self.provider, partition.window)


def register_provider(spark: SparkSession, name: str, make: Callable[[dict], BarProvider]) -> None:
    """Make ``spark.read.format(name)`` and ``spark.readStream.format(name)`` read a provider; ``make`` gets the options.

    The option ``parts`` says in how many ranges at most it is read.
    """
    if not name.isidentifier():
        raise InvalidArgument("a provider's name is a word")

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return BARS

        def _made(self) -> tuple[BarProvider, int]:
            options = dict(self.options)
            return make(options), int(options.get("parts", 8))

        def reader(self, schema: object) -> DataSourceReader:
            return _Reader(*self._made())

        def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
            return _StreamReader(*self._made())

    spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(Source)


@dataclass(frozen=True)
class TickTable:
    """Bars of one price each from a Parquet table of events: a provider over a file, in place of one over a network."""

    path: str

    def _data(self):
        import pyarrow.dataset as ds

        return ds.dataset(self.path)

    def _times(self):
        return self._data().schema.field("ts").type

    def ranges(self, parts: int) -> list[tuple[int, int]]:
        ends = [pc.min_max(b["user_id"]) for b in self._data().to_batches(columns=["user_id"]) if b.num_rows]
        if not ends:
            return []
        low, high = min(e["min"].as_py() for e in ends), max(e["max"].as_py() for e in ends)
        wide = -(-(high - low + 1) // parts)
        return [(a, min(a + wide - 1, high)) for a in range(low, high + 1, wide)]

    def bars(self, window: Window) -> Iterator[pa.RecordBatch]:
        kind = self._times()
        at = lambda t: pa.scalar(utc(t).replace(tzinfo=None), pa.timestamp("us")).cast(kind)
        kept = pc.is_valid(pc.field("user_id"))
        for column, value, keep in (("user_id", window.low, True), ("user_id", window.high, False), ("ts", window.start, True), ("ts", window.end, False)):
            if value is not None:
                v = value if column == "user_id" else at(value)
                kept &= pc.field(column) >= v if keep else pc.field(column) <= v
        for b in self._data().to_batches(columns=["user_id", "ts", "value"], filter=kept):
            if b.num_rows:
                one = pa.array([1.0] * b.num_rows)
                yield pa.RecordBatch.from_arrays([b["user_id"], b["ts"].cast(pa.timestamp("us")), *[b["value"]] * 4, one], names=_ARROW.names)

    def newest(self) -> dt.datetime | None:
        ends = [pc.max(b["ts"]).as_py() for b in self._data().to_batches(columns=["ts"]) if b.num_rows]
        return max(ends, default=None)
