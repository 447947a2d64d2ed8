"""Leakage-free datasets: features of bars up to a date, a label of the bars after it, audited drops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.features import Feature, Registry, add_features
from tidemark.functions.scalars import is_finite, strict_float64
from tidemark.functions.windows import DATE, ID, no_repeats, repeats
from tidemark.operators.targets import Target, ahead, label


@dataclass(frozen=True)
class Dataset:
    """``rows`` are complete; ``marked`` are all candidates with ``drop_reason``."""

    rows: DataFrame
    marked: DataFrame
    features: list[str]

    def drop_counters(self) -> DataFrame:
        """Per instrument: a row that lacks a feature counts there, whether or not it has a label."""
        n = lambda r: F.count_if(F.col("drop_reason").eqNullSafe(r))
        return self.marked.groupBy(ID).agg(
            F.count(F.lit(1)).alias("candidates"), n("feature").alias("dropped_features"), n("target").alias("dropped_target"), n(None).alias("kept")
        )


def _complete(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= is_finite(F.col(n))
    return out


def _requested(marked: DataFrame, dates: DataFrame | None) -> DataFrame:
    """Only the dates asked for (instrument, date); those without a bar are skipped, and one that is asked for twice raises. Lookback is not affected."""
    if dates is None:
        return marked
    asked = dates.groupBy(ID, F.col(DATE).alias("observation_date")).agg(F.count(F.lit(1)).alias("_n"))
    once = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("requested twice: "), F.col("observation_date").cast("string"))).cast("boolean")).otherwise(True)
    return marked.join(asked.where(once).drop("_n"), [ID, "observation_date"], "left_semi")


def build(
    bars: DataFrame,
    features: list[Feature],
    target: Target,
    actions: DataFrame | None = None,
    dates: DataFrame | None = None,
    registry: Registry | None = None,
    order: str = DATE,
    rows_per_block: int | None = None,
) -> Dataset:
    """Labelled rows of all instruments. Bars go by ``order``, a date or a timestamp; two bars of an instrument with one date (or time) raise.

    ``rows_per_block``: longer series are dealt to blocks (``add_features``).
    """
    names = [f.name for f in features]
    if set(names) & {"target", "realization_date", "observation_date"}:
        raise InvalidArgument("a feature has the name of another column")
    extra = lambda: ahead(target.horizon, target.column) | repeats()
    rows = add_features(bars, features, registry, extra, order, rows_per_block, target.horizon).where(no_repeats(order))
    rows = label(rows, target, bars, actions, order).withColumnRenamed(order, "observation_date")
    reason = F.when(~_complete(names), "feature").when(~is_finite(F.col("target")), "target")
    marked = rows.withColumn("drop_reason", reason)
    marked = _requested(marked.select(ID, "observation_date", "realization_date", *names, "target", "drop_reason"), dates)
    return Dataset(marked.where("drop_reason is null").drop("drop_reason"), marked, names)


def inference(
    bars: DataFrame, features: list[Feature], dates: DataFrame | None = None, registry: Registry | None = None, order: str = DATE, rows_per_block: int | None = None
) -> DataFrame:
    """Rows without a label, up to the newest bar."""
    names = [f.name for f in features]
    rows = add_features(bars, features, registry, repeats, order, rows_per_block).where(no_repeats(order))
    return _requested(rows.withColumnRenamed(order, "observation_date").select(ID, "observation_date", *names).where(_complete(names)), dates)


def dense(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as one array of doubles, in order, for the hand-off to numpy; a value that no double holds raises."""
    return rows.select(ID, "observation_date", F.array(*[strict_float64(F.col(f), f) for f in features]).alias("x"), *(["target"] if "target" in rows.columns else []))


def records(rows: DataFrame, features: list[str]) -> DataFrame:
    """Rows as records: the keys, and ``features`` as one map from name to value."""
    pairs = [x for f in features for x in (F.lit(f), F.col(f).cast("double"))]
    return rows.select(ID, "observation_date", F.create_map(*pairs).alias("record"))


def definitions(rows: DataFrame, keys: tuple[str, ...] = (ID, "observation_date", "realization_date", "target")) -> list[tuple[str, str | None]]:
    """Feature columns in order, each with its definition (family and parameters, as its metadata has it) if it says one."""
    return [(f.name, (f.metadata or {}).get("feature")) for f in rows.schema.fields if f.name not in keys]


def same_features(train: DataFrame, other: DataFrame, keys: tuple[str, ...] = (ID, "observation_date", "realization_date", "target")) -> None:
    """An error unless both have the same features in the same order, by number, name and definition. Definitions outlive Parquet."""
    a, b = definitions(train, keys), definitions(other, keys)
    if len(a) != len(b):
        raise InvalidArgument(f"{len(a)} and {len(b)} features")
    if [n for n, _ in a] != [n for n, _ in b]:
        raise InvalidArgument(f"features differ: {[n for n, _ in a]} and {[n for n, _ in b]}")
    redefined = [n for (n, x), (_, y) in zip(a, b, strict=True) if x != y]
    if redefined:
        raise InvalidArgument(f"features of one name are defined differently: {redefined}")
