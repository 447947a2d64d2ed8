"""Ingestion as a whole: validate a batch, classify it against the store, upsert it, and write one audit row for each instrument.

A batch has rows of many instruments; each is a run of its own. A run whose rows break a rule fails as a whole: it changes nothing,
and its audit row says the first violation in order of arrival. The other runs succeed.

``ingest_bars`` and ``ingest_fundamentals`` are plans over tables; ``run_bars`` and ``run_fundamentals`` do it: they write runs as RUNNING, classify and
upsert the batch, and write how the runs ended.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, InvalidData
from tidemark.files import delete
from tidemark.functions.scalars import check_range
from tidemark.functions.windows import DATE, ID
from tidemark.operators.quality import Rules, bar_rules, first_violation, fundamental_rules
from tidemark.operators.store import STATUS, KeyedTable
from tidemark.operators.upsert import INSERTED, SKIPPED, UPDATED, classify, upsert

PERIOD_KEY = [ID, "period_end", "metric_name", "fiscal_year", "fiscal_quarter"]
RUNNING, SUCCESS, FAILED = "RUNNING", "SUCCESS", "FAILED"
COUNTS = ["received_count", "inserted_count", "updated_count", "skipped_count"]


@dataclass(frozen=True)
class Ingested:
    """``table``: the store afterwards. ``runs``: one audit row for each instrument asked for."""

    table: DataFrame
    runs: DataFrame


@dataclass(frozen=True)
class Kind:
    """What is ingested: its key, its rules row by row, and those that are looked at when no row breaks one of the first."""

    name: str
    key: list[str]
    rules: Rules
    late: Rules


def _batch_rules(key: list[str], index: str, at: str, start: str | None, end: str | None) -> Rules:
    """What holds for a batch: known instruments, a date in the range that was asked for (open where there is no bound), no key twice."""
    check_range(start, end)
    day, outside = F.col(at), F.lit(False)
    if start is not None:
        outside |= day < F.lit(start).cast("timestamp")
    if end is not None:
        outside |= day > F.lit(end).cast("timestamp")
    return [
        ("unknown_instrument", F.col("_known").isNull()),
        ("no_timestamp", day.isNull()),
        ("out_of_range", outside),
        ("duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(index)) > 1),
    ]


def _bars(start: str | None, end: str | None, index: str, order: str) -> Kind:
    """Bars also ascend in order of arrival."""
    before = F.lag(order).over(Window.partitionBy(ID).orderBy(index))
    return Kind("price", [ID, order], [*_batch_rules([ID, order], index, order, start, end), *bar_rules()], [("out_of_order", before > F.col(order))])


def _fundamentals(start: str | None, end: str | None, index: str) -> Kind:
    return Kind("fundamentals", PERIOD_KEY, [*_batch_rules(PERIOD_KEY, index, "period_end", start, end), *fundamental_rules()], [])


def _judged(batch: DataFrame, asked: DataFrame, kind: Kind) -> DataFrame:
    """``batch`` with the rule that each row breaks, of the first or of the late ones."""
    known = batch.join(asked.withColumn("_known", F.lit(True)), ID, "left")
    return known.withColumns({"_violation": first_violation(kind.rules), "_late": first_violation(kind.late)}).drop("_known")


def _verdicts(seen: DataFrame, index: str) -> DataFrame:
    """One aggregation says which runs fail, and why."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(index).alias("i"), F.col(c).alias("v"))))["v"]
    return seen.groupBy(ID).agg(F.coalesce(first("_violation"), first("_late")).alias("error_message"))


def _counted(classified: DataFrame, status: str = "status") -> DataFrame:
    n = lambda s: F.count_if(F.col(status) == s)
    return classified.groupBy(ID).agg(
        F.count(F.lit(1)).alias("received_count"), n(INSERTED).alias("inserted_count"), n(UPDATED).alias("updated_count"), n(SKIPPED).alias("skipped_count")
    )


def _ended(asked: DataFrame, verdicts: DataFrame, counted: DataFrame, kind: Kind) -> DataFrame:
    runs = asked.join(verdicts, ID, "full_outer").join(counted, ID, "left")
    zero: dict[str, Column] = {c: F.coalesce(c, F.lit(0)) for c in COUNTS}
    runs = runs.withColumns(zero | {"status": F.when(F.col("error_message").isNull(), SUCCESS).otherwise(FAILED), "ingestion_type": F.lit(kind.name)})
    return runs.select(ID, "ingestion_type", "status", *COUNTS, "error_message")


def _ingest(batch: DataFrame, store: DataFrame, requested: DataFrame, kind: Kind, index: str) -> Ingested:
    asked = requested.select(ID).distinct()
    verdicts = _verdicts(_judged(batch, asked, kind), index)
    good = batch.join(verdicts.where("error_message is null").select(ID), ID, "left_semi")
    classified = classify(good, store, kind.key, [c for c in store.columns if c not in kind.key])
    changed = classified.where(F.col("status") != SKIPPED).select(*store.columns)
    return Ingested(upsert(changed, store, kind.key), _ended(asked, verdicts, _counted(classified), kind))


def ingest_bars(batch: DataFrame, store: DataFrame, requested: DataFrame, start: str | None, end: str | None, index: str = "batch_index", order: str = DATE) -> Ingested:
    """Bars (with their order of arrival in ``index``) of the requested instruments between two days or times; without one of them the range is open there."""
    return _ingest(batch, store, requested, _bars(start, end, index, order), index)


def ingest_fundamentals(batch: DataFrame, store: DataFrame, requested: DataFrame, start: str | None, end: str | None, index: str = "batch_index") -> Ingested:
    """Fundamental records; a period without a fiscal year or quarter is a key as well."""
    return _ingest(batch, store, requested, _fundamentals(start, end, index), index)


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


def _run(batch: DataFrame, table: KeyedTable, runs: KeyedTable, requested: DataFrame, kind: Kind, provider: str, run_id: str, index: str) -> DataFrame:
    if "/" in run_id or not run_id:
        raise InvalidArgument("a run's id is a plain name")
    started, spark = _now(), table.spark
    asked = requested.select(ID).distinct()
    own = lambda: runs.read().where(F.substring_index("run_id", ":", 1) == run_id)
    audit = lambda df, ended: df.select(
        F.concat(F.lit(f"{run_id}:"), F.col(ID).cast("string")).alias("run_id"), F.col(ID).cast("string").alias(ID), F.lit(kind.name).alias("ingestion_type"), F.lit(provider).alias("provider"),
        F.lit(started).alias("started_at"), F.lit(ended).cast("timestamp").alias("completed_at"), "status", *[F.col(c).cast("int").alias(c) for c in COUNTS], "error_message",
    )
    states = {r[0] for r in own().select("status").distinct().collect()}
    if states and RUNNING not in states:
        return own()  # done before
    open_ = asked.withColumns({"status": F.lit(RUNNING), "error_message": F.lit(None).cast("string")} | {c: F.lit(0) for c in COUNTS})
    runs.save(audit(open_, None), batch=f"{run_id}-begin")
    judged = f"{table.path}/_runs/{run_id}"
    try:
        seen = _judged(batch.select(*[c for c in table.schema.fieldNames() if c in batch.columns], index), asked, kind)
        seen.write.mode("overwrite").parquet(judged)  # rules are looked at once
        seen = spark.read.schema(seen.schema).parquet(judged)
        verdicts = _verdicts(seen, index)
        good = seen.join(verdicts.where("error_message is null").select(ID), ID, "left_semi")
        saved = table.save(good.withColumns({c: F.lit(None).cast(table.schema[c].dataType) for c in table.schema.fieldNames() if c not in good.columns}), batch=run_id)
        ended = _ended(asked, verdicts, _counted(saved.rows, STATUS), kind)
        runs.save(audit(ended, _now()), batch=f"{run_id}-end")
    except Exception as e:
        failed = open_.withColumns({"status": F.lit(FAILED), "error_message": F.lit(str(e)[:1000])})
        runs.save(audit(failed, _now()), batch=f"{run_id}-failed")
        raise
    finally:
        delete(spark, judged)
        for stage in ("begin", "end", "failed"):
            runs.forget(f"{run_id}-{stage}")
    table.forget(run_id)
    return own()


def run_bars(
    batch: DataFrame, bars: KeyedTable, runs: KeyedTable, requested: DataFrame, start: str | None, end: str | None, provider: str, run_id: str, index: str = "batch_index", order: str = DATE
) -> DataFrame:
    """Ingest bars into a table and return the audit rows of its runs, one for each instrument (``run_id`` and the instrument, after a colon).

    Runs are RUNNING from the start on, then SUCCESS with counts or FAILED with the first violation; if Spark itself fails, all are FAILED with its message
    and the error goes on. A run that has ended isn't done again: its rows are returned. One that was broken off is, with the counts that it
    would have had, since the batch's classification outlives the table's change.
    """
    return _run(batch, bars, runs, requested, _bars(start, end, index, order), provider, run_id, index)


def run_fundamentals(batch: DataFrame, records: KeyedTable, runs: KeyedTable, requested: DataFrame, start: str | None, end: str | None, provider: str, run_id: str, index: str = "batch_index") -> DataFrame:
    """As ``run_bars``, for fundamental records."""
    return _run(batch, records, runs, requested, _fundamentals(start, end, index), provider, run_id, index)


def require_success(runs: DataFrame) -> DataFrame:
    """``runs``, or an error that names some of those that failed and why."""
    bad = runs.where(F.col("status") != SUCCESS).select(ID, "error_message").limit(5).collect()
    if bad:
        raise InvalidData(f"ingestion failed, for instance {[tuple(r) for r in bad]}")
    return runs
