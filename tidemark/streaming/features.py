"""Features that follow a stream of bars: late and revised bars reach all features that they change, and no others are computed again.

The state of the stream is two keyed tables, of bars and of features. A batch is upserted into the bars; from the partition (month or year) on that has an
instrument's earliest bar that it changes, its features are computed again, from the bars before it that windows look at and the state that smoothing had
there, which is kept beside the features of an instrument's last bar in each partition. They take the place of those that were there. Partitions are done in order, in a
few groups, each from the states that the one before has left, so that room is needed for a group beside the tables, not for all features once more.

A batch that runs again after a failure gives the same tables: it begins at states that it hasn't changed. State is not held in executors, so a lost one
costs its tasks only. How late a revision comes doesn't matter.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.files import exists
from tidemark.functions.features import Feature, Registry, add_from, default_registry, state_columns
from tidemark.functions.windows import DATE, ID
from tidemark.operators.store import PART, STATUS, KeyedTable, grouped
from tidemark.operators.upsert import SKIPPED
from tidemark.schemas import Part
from tidemark.session import shuffles_freed

SINCE, END = "_since", "_end"


def _before(a: str, b: str) -> bool:
    """Whether all of partition ``a`` is before ``b``, each a month or a year."""
    return a[: len(b)] < b[: len(a)]


class FeatureStream:
    """Features of a table of bars below ``path``, in partitions like theirs by month or year."""

    def __init__(self, spark: SparkSession, path: str, bars: KeyedTable, features: list[Feature], order: str = DATE, part: str = "month", registry: Registry | None = None):
        self.bars, self.features, self.order, self.kind, self.registry = bars, features, order, part, registry or default_registry()
        self.names, self.kept = [f.name for f in features], state_columns(features, self.registry)
        self.lookback = max([1, *(self.registry.lookback(f) for f in features)])
        fields = [bars.schema[ID], bars.schema[order], *[T.StructField(n, T.DoubleType()) for n in self.names], *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in self.kept]]
        self.since = T.StructType([fields[0], T.StructField(SINCE, fields[1].dataType)])
        self.table = KeyedTable(spark, path, T.StructType(fields), [ID, order], Part(order, part))

    def read(self) -> DataFrame:
        """The features of all bars so far."""
        return self.table.read().select(ID, self.order, *self.names)

    def apply(self, batch: DataFrame, number: int) -> None:
        """Take in one batch of bars (with ``arrival`` if bars can repeat). A stream goes on only when a batch is done, so what was kept of the one before goes first."""
        self.forget(number - 1)
        rows = batch if "arrival" in batch.columns else batch.withColumn("arrival", F.monotonically_increasing_id())
        spark, name = self.bars.spark, f"stream-{number}"
        with shuffles_freed(spark):
            at = self.table.staged(name)
            if not exists(spark, f"{at}/_SUCCESS"):
                changed = self.bars.save(rows, "arrival", name, piecewise=True).rows.where(F.col(STATUS) != SKIPPED)
                changed.groupBy(ID).agg(self._begin(F.min(self.order)).alias(SINCE)).write.mode("overwrite").parquet(at)
            self.bars.forget(name)  # the bars are there, and since when they have changed says the rest
            since = spark.read.schema(self.since).parquet(at)
            first = since.agg(F.min(SINCE)).first()[0]
            if first is not None:
                (since_part,) = spark.range(1).select(F.lit(first).alias(self.order)).select(self.bars.part).first()
                sizes = self.bars.sizes()
                for group in grouped({p: n for p, n in sizes.items() if since_part <= p != "none"}):
                    self._again(since, [*sizes], group)

    def forget(self, number: int) -> None:
        """Drop what is kept of a batch that won't come again."""
        for table in (self.bars, self.table):
            table.forget(f"stream-{number}")

    def _begin(self, at: Column) -> Column:
        """Where the partition of a date or time begins."""
        return F.date_trunc(self.kind, at).cast(self.table.schema[self.order].dataType)

    def _again(self, since: DataFrame, parts: list[str], group: list[str]) -> None:
        """Features of the bars in a group of partitions, from each instrument's ``since`` on, in place of those that are there."""
        start = begin = bisect_left(parts, group[0])
        end, step = bisect_left(parts, group[-1]) + 1, 1
        lower = F.lit(group[0] + {4: "-01-01", 7: "-01"}[len(group[0])]).cast(self.table.schema[self.order].dataType)
        since = since.withColumn(SINCE, F.greatest(SINCE, lower))
        touched = lambda table, listed: table.read(listed).join(since, ID)
        later = F.col(self.order) >= F.col(SINCE)
        # Go back in time until each of them has the bars that windows look at, or all that there are.
        while start > 0:
            start, step = max(0, start - step), step * 2
            before = touched(self.bars, parts[start:end]).where(~later).groupBy(ID).count()
            if start and since.join(before, ID, "left").where(F.coalesce("count", F.lit(0)) < self.lookback).isEmpty():
                break
        near = touched(self.bars, parts[start:end])
        # The last bars before, newest first: the optimizer keeps so many of each before the shuffle.
        place = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc(self.order)))
        earlier = near.where(~later).withColumn("_back", place).where(F.col("_back") <= self.lookback).drop("_back")
        frame, after = near.where(later).unionByName(earlier), F.lead(self.order).over(Window.partitionBy(ID).orderBy(self.order))
        frame = frame.withColumn(END, F.coalesce(self._begin(after) != self._begin(F.col(self.order)), F.lit(True)))
        there = self.table.parts()
        states = None
        if self.kept:
            newest = touched(self.table, [p for p in there if not _before(p, parts[start]) and not _before(group[-1], p)]).where(~later & F.col(self.kept[0]).isNotNull())
            states = newest.groupBy(ID).agg(*[F.max_by(c, self.order).alias(c) for c in self.kept])
        new = add_from(frame, self.features, SINCE, END, self.registry, self.order, states)
        new = new.withColumn(PART, self.table.part).select(ID, self.order, *self.names, *self.kept, PART)
        meets = lambda p: any(not _before(p, g) and not _before(g, p) for g in group)
        old = self.table.stored([p for p in there if meets(p)]).join(since, ID, "left").where(F.col(SINCE).isNull() | ~later).drop(SINCE)
        self.table.overwrite(new.unionByName(old))


def follow(stream: DataFrame, features: FeatureStream, checkpoint: str) -> StreamingQuery:
    """Take in all that is there, batch by batch, and stop."""
    return stream.writeStream.foreachBatch(features.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
