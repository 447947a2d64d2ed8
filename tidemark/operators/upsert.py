"""Classified upserts: what a batch inserts, updates and skips, and the table afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import KEYS

INSERTED, UPDATED, SKIPPED = "inserted", "updated", "skipped"


def last_arrivals(incoming: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """One row per key, the last to arrive: an aggregation with partial maxima."""
    kept = [c for c in incoming.columns if c not in keys]
    return incoming.groupBy(*keys).agg(F.max_by(F.struct(*kept), arrival).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in kept])


def only_arrivals(incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming``; a key that it holds twice raises, since nothing says which row counts."""
    kept = [c for c in incoming.columns if c not in keys]
    one = incoming.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*kept)).alias("_r"))
    twice = F.raise_error(F.concat(F.lit("a key comes twice: "), F.to_json(F.struct(*keys)))).cast("boolean")
    return one.where(F.when(F.col("_n") > 1, twice).otherwise(True)).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in kept])


def classify(incoming: DataFrame, target: DataFrame, keys: list[str], values: list[str], name: str = "status") -> DataFrame:
    """``incoming`` (one row per key) with its status in column ``name``; keys and values compare null-safe."""
    t = target.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_v_{v}") for v in values], F.lit(True).alias("_there"))
    on = [incoming[k].eqNullSafe(t[f"_k_{k}"]) for k in keys]
    same = F.lit(True)
    for v in values:
        same &= F.col(v).eqNullSafe(F.col(f"_v_{v}"))
    status = F.when(F.col("_there").isNull(), INSERTED).when(same, SKIPPED).otherwise(UPDATED)
    return incoming.join(t, on, "left").withColumn(name, status).drop(*[f"_k_{k}" for k in keys], *[f"_v_{v}" for v in values], "_there")


def upsert(incoming: DataFrame, target: DataFrame, keys: list[str], surrogate: str | None = None) -> DataFrame:
    """``target`` after the batch: incoming rows win, a row that is there keeps its surrogate id, the rest stays."""
    cols = target.columns
    i = incoming.select(*[F.col(c).alias(f"_i_{c}") for c in cols], F.lit(True).alias("_new"))
    on = [target[k].eqNullSafe(i[f"_i_{k}"]) for k in keys]
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_i_{c}")) if c == surrogate else F.when(F.col("_new"), F.col(f"_i_{c}")).otherwise(F.col(c))
    return target.join(i, on, "full_outer").select(*[pick(c).alias(c) for c in cols])


def counts(classified: DataFrame, by: list[str], name: str = "status") -> DataFrame:
    """Audit counters of a run."""
    n = lambda s: F.count_if(F.col(name) == s)
    return classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"), n(INSERTED).alias("inserted"), n(UPDATED).alias("updated"), n(SKIPPED).alias("skipped")
    )


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def save(incoming: DataFrame, target: DataFrame, table: str, arrival: str | None = None, surrogate: str | None = None) -> DataFrame:
    """``upsert`` by the key that the schema names for the table; with ``arrival`` the last row to arrive of each key counts."""
    keys = KEYS[table]
    return upsert(last_arrivals(incoming, keys, arrival) if arrival else incoming, target, keys, surrogate)
