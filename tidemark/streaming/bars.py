"""Bars that arrive as a stream: each micro-batch is an idempotent, audited upsert of a keyed table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.files import exists
from tidemark.functions.windows import DATE, ID
from tidemark.operators.store import STATUS, KeyedTable
from tidemark.operators.upsert import counts
from tidemark.schemas import Part


def bar_table(spark: SparkSession, path: str, schema: StructType, order: str = DATE, part: str = "month") -> KeyedTable:
    """Bars by instrument and date (or time), in partitions by month (or year): a batch of new bars touches the newest."""
    return KeyedTable(spark, path, schema, [ID, order], Part(order, part))


def apply(table: KeyedTable, batch: DataFrame, number: int, audit: str) -> DataFrame:
    """Upsert one batch; returns its counts for each instrument, which are also written below ``audit``.

    A batch that runs again, after a failure at any point, leaves the same table and the same counts. What the batch before was classified
    as is dropped, since a stream goes on only when a batch is done.
    """
    rows = batch if "arrival" in batch.columns else batch.withColumn("arrival", F.monotonically_increasing_id())
    saved = table.save(rows, "arrival", f"stream-{number}")
    at = f"{audit}/batch={number}"
    out = counts(saved.rows, [ID], STATUS)
    out.write.mode("overwrite").parquet(at)
    table.forget(f"stream-{number - 1}")
    return table.spark.read.schema(out.schema).parquet(at)


def audit_of(spark: SparkSession, audit: str) -> DataFrame | None:
    """The counts of all batches so far, with ``batch``; none before the first."""
    return spark.read.parquet(audit) if exists(spark, audit) else None


def ingest(stream: DataFrame, table: KeyedTable, checkpoint: str, audit: str | None = None) -> StreamingQuery:
    """Upsert all that is there, batch by batch, and stop.

    ``stream`` has the bars' columns, and ``arrival`` if bars of one batch can repeat; otherwise the order of rows stands for it.
    """
    to = audit or f"{checkpoint}-audit"
    run = lambda batch, number: apply(table, batch, number, to) and None
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
