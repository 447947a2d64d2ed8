"""Keyed tables on disk: Parquet in partitions, upserted by Spark's dynamic partition overwrite.

The partition of a row follows from its key, so a key lives in one partition. A batch is reduced to a row a key, classified against the partitions
that it touches, and only partitions in which something changes are written again; the files of all others stay as they are.

A batch with a name can be saved again: its classification is kept until ``forget``, so the counts are those of the first time even if
the table was written in between, and the table is the same. Overwritten partitions are swapped in when the whole write is done; ``piecewise``, when
their group is done.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.errors import InvalidArgument
from tidemark.files import any_folder, delete, exists, names_in, size
from tidemark.operators.upsert import INSERTED, SKIPPED, UPDATED, classify, last_arrivals, only_arrivals, upsert
from tidemark.schemas import KEYS, PARTS, SURROGATES, TABLES, Part
from tidemark.session import shuffles_freed

PART, STATUS = "kt_part", "kt_status"
#: Partitions that are written together, in bytes: so many, or an eighth of all if that is more.
GROUP, GROUPS = 16 << 20, 8


@dataclass(frozen=True)
class Saved:
    """``rows``: the batch as classified (one row a key, with ``kt_status``). The counts are of all of them."""

    rows: DataFrame
    received: int
    inserted: int
    updated: int
    skipped: int


def grouped(sizes: dict[str, float]) -> list[list[str]]:
    """Partitions in order, in groups of about one size (a large partition is a group of its own), so that there are a few jobs whatever their number."""
    most, out, full = max(GROUP, sum(sizes.values()) / GROUPS), [], float("inf")
    for p in sorted(sizes):
        if full + sizes[p] > most:
            out, full = [*out, []], 0.0
        out[-1].append(p)
        full += sizes[p]
    return out


class KeyedTable:
    """A table with a unique key below ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], part: Part, surrogate: str | None = None):
        if part.column not in keys:
            raise InvalidArgument("a row's partition must follow from its key")
        self.spark, self.path, self.schema, self.keys, self.surrogate = spark, path.rstrip("/"), schema, keys, surrogate
        self.part: Column = part.of()

    def staged(self, batch: str) -> str:
        """Where a batch is kept until ``forget``."""
        return f"{self.path}/_batches/{batch}"  # readers leave out names that begin with an underscore

    def stored(self, parts: list[str] | None) -> DataFrame:
        """As ``read``, with the partition of each row."""
        stored = StructType([*self.schema.fields]).add(PART, "string")
        if not any_folder(self.spark, f"{self.path}/{PART}=*"):
            return self.spark.createDataFrame([], stored)
        rows = self.spark.read.schema(stored).parquet(self.path)
        return rows if parts is None else rows.where(F.col(PART).isin(parts))

    def read(self, parts: list[str] | None = None) -> DataFrame:
        """All rows, or those of some partitions: others are not listed as input."""
        return self.stored(parts).drop(PART)

    def parts(self) -> list[str]:
        """The table's partitions, in order."""
        return sorted(n.removeprefix(f"{PART}=") for n in names_in(self.spark, self.path) if n.startswith(f"{PART}="))

    def sizes(self) -> dict[str, int]:
        """Bytes of each partition."""
        return {p: size(self.spark, f"{self.path}/{PART}={p}") for p in self.parts()}

    def save(self, rows: DataFrame, arrival: str | None = None, batch: str | None = None, piecewise: bool = False) -> Saved:
        """Upsert ``rows``, cast to the table's types. With ``arrival`` the last of each key to arrive counts; without it, a key that comes twice raises.

        ``piecewise``: groups of partitions are written one after the other, so there is room needed for one group beside the table, not for all. A write
        that fails leaves some of them, so it is for batches that come again until they are done.
        """
        with shuffles_freed(self.spark, rows.sparkSession):
            return self._save(rows, arrival, batch or uuid.uuid4().hex, piecewise)

    def _save(self, rows: DataFrame, arrival: str | None, batch: str, piecewise: bool) -> Saved:
        names = self.schema.fieldNames()
        values = [c for c in names if c not in {*self.keys, self.surrogate}]
        staged, counts = self.staged(batch), None
        if not exists(self.spark, f"{staged}/_SUCCESS"):
            wanted = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], *([arrival] if arrival else []))
            new = last_arrivals(wanted, self.keys, arrival) if arrival else only_arrivals(wanted, self.keys)
            stored = StructType([*self.schema.fields]).add(PART, "string")
            new = new.withColumn(PART, self.part).select(*stored.fieldNames())
            if self.parts():
                new.write.mode("overwrite").parquet(f"{staged}-rows")  # computed once
                new = self.spark.read.schema(stored).parquet(f"{staged}-rows")
                marked = classify(new, self.stored(self._listed(new)), self.keys, values, STATUS)
            else:  # there is nothing that it could meet
                marked = new.withColumn(STATUS, F.lit(INSERTED))
            n = lambda s: F.count_if(F.col(STATUS) == s).alias(s)
            found = Observation()
            marked.observe(found, n(INSERTED), n(UPDATED), n(SKIPPED)).select(*names, PART, STATUS).write.mode("overwrite").parquet(staged)
            counts = found.get
            delete(self.spark, f"{staged}-rows")
        saved = self.spark.read.schema(StructType([*self.schema.fields]).add(PART, "string").add(STATUS, "string")).parquet(staged)
        if counts is None or sum(counts.values()) == 0:
            counts = {r[0]: r[1] for r in saved.groupBy(STATUS).count().collect()}
        inserted, updated, skipped = (counts.get(s, 0) for s in (INSERTED, UPDATED, SKIPPED))
        changed = saved.where(F.col(STATUS) != SKIPPED)
        if piecewise:
            there, each = self.sizes(), size(self.spark, staged) / max(1, inserted + updated + skipped)
            groups = grouped({r[0]: there.get(r[0], 0) + r[1] * each for r in changed.groupBy(PART).count().collect()})
        else:
            groups = [parts] if (parts := self._listed(changed)) else []
        for parts in groups:
            own = changed.where(F.col(PART).isin(parts)).select(*names, PART)
            old = sorted({*parts} & {*self.parts()})
            self.overwrite(upsert(own, self.stored(old), self.keys, self.surrogate) if old else own)
        return Saved(saved.drop(PART), inserted + updated + skipped, inserted, updated, skipped)

    def overwrite(self, rows: DataFrame) -> None:
        """Write partitions anew: ``rows``, with their partition, are all that is in them. Files are of the advised size, however large a partition is."""
        rows.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.path)

    @staticmethod
    def _listed(rows: DataFrame) -> list[str]:
        """Partitions of some rows: as many as the table has folders."""
        return sorted(r[0] for r in rows.select(PART).distinct().collect())

    def forget(self, batch: str) -> None:
        """Drop what was kept of a batch that won't come again."""
        delete(self.spark, self.staged(batch))


def open_table(spark: SparkSession, path: str, name: str) -> KeyedTable:
    """One of the domain's tables."""
    return KeyedTable(spark, path, TABLES[name], KEYS[name], PARTS[name], SURROGATES.get(name))
