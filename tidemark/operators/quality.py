"""Batch assertions: each gives the rows that break a rule and the rule's name, the first in order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, InvalidData
from tidemark.functions.scalars import blank_to_null, check_range, is_finite
from tidemark.functions.windows import DATE, ID

Rules = list[tuple[str, Column]]


def first_violation(rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for name, broken in reversed(rules):
        out = F.when(broken, F.lit(name)).otherwise(out)
    return out


def violations(rows: DataFrame, rules: Rules) -> DataFrame:
    return rows.withColumn("violation", first_violation(rules)).where("violation is not null")


def bar_rules() -> Rules:
    o, h, lo, c, v = values = [F.col(x) for x in ("open", "high", "low", "close", "volume")]
    missing = F.lit(False)
    for x in values:
        missing |= x.isNull()
    return [
        ("missing", missing),
        ("negative", (o < 0) | (h < 0) | (lo < 0) | (c < 0) | (v < 0)),
        ("high_below_low", h < lo),
        ("open_out_of_range", (o < lo) | (o > h)),
        ("close_out_of_range", (c < lo) | (c > h)),
    ]


def bar_batch(batch: DataFrame, instrument: int | str, start: str, end: str, index: str = "batch_index") -> DataFrame:
    """The violation of each row; ``is_first`` marks the one that a strict ingest raises."""
    check_range(start, end)
    repeated = F.row_number().over(Window.partitionBy(ID, DATE).orderBy(index)) > 1
    rules = [
        ("wrong_instrument", F.col(ID) != instrument),
        ("no_timestamp", F.col(DATE).isNull()),
        ("out_of_range", ~F.col(DATE).between(F.lit(start).cast("date"), F.lit(end).cast("date"))),
        ("duplicate", repeated),
    ]
    return mark_first(violations(batch, rules), index)


def mark_first(found: DataFrame, index: str) -> DataFrame:
    """``is_first``: the violation that a strict ingest raises, the one of the least index. An equi-join with one row."""
    least = found.agg(F.min(index).alias("_least"))
    return found.join(F.broadcast(least), F.col(index) == F.col("_least"), "left").withColumn("is_first", F.col("_least").isNotNull()).drop("_least")


def out_of_order(batch: DataFrame, index: str = "batch_index") -> DataFrame:
    """Rows whose date is before that of the row that arrived before them."""
    before = F.lag(DATE).over(Window.partitionBy(ID).orderBy(index))
    return batch.withColumn("previous_date", before).where(F.col("previous_date") > F.col(DATE))


def fundamental_rules() -> Rules:
    return [
        ("metric_blank", blank_to_null(F.col("metric_name")).isNull()),
        ("year_too_early", F.col("fiscal_year") < 1900),
        ("quarter_out_of_range", ~F.col("fiscal_quarter").between(1, 4)),
        ("available_before_published", F.col("available_at") < F.col("published_at")),
    ]


def currency_rule() -> Rules:
    """For records with a currency: it may be missing, but not blank."""
    return [("currency_blank", F.col("currency").isNotNull() & blank_to_null(F.col("currency")).isNull())]


def zone_rules(*columns: str) -> Rules:
    """Text stamps that say no offset from UTC: which instant they mean can't be known. A trailing Z or offset is one."""
    return [(f"{c}_without_zone", ~F.col(c).rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")) for c in columns]


def fundamental_batch(records: DataFrame, start: str, end: str, instrument: int | str | None = None, stamps: tuple[str, ...] = ()) -> DataFrame:
    """Records of another instrument than the expected one (if given), out of the period range, with a text stamp that names no zone
    (``stamps``), or whose key (null-safe) is not the only one."""
    check_range(start, end)
    key = Window.partitionBy(ID, "period_end", "metric_name", "fiscal_year", "fiscal_quarter")
    rules = [
        ("out_of_range", ~F.col("period_end").between(F.lit(start).cast("date"), F.lit(end).cast("date"))),
        *zone_rules(*stamps),
        ("duplicate", F.count(F.lit(1)).over(key) > 1),
    ]
    if instrument is not None:
        rules.insert(0, ("wrong_instrument", F.col(ID) != instrument))
    return violations(records, rules)


def action_rules() -> Rules:
    return [
        ("unknown_type", ~F.coalesce(F.lower(F.trim("action_type")), F.lit("")).isin("split", "dividend")),
        ("value_not_positive", ~(is_finite(F.col("value")) & (F.col("value") > 0))),
        ("currency_blank", F.col("currency").isNotNull() & blank_to_null(F.col("currency")).isNull()),
    ]


def dataset_report(rows: DataFrame, features: list[str]) -> DataFrame:
    """Per instrument: rows and how many break each rule of a dataset."""
    before = F.lag("observation_date").over(Window.partitionBy(ID).orderBy("observation_date"))
    bad = F.lit(False)
    for f in [*features, "target"]:
        bad |= ~is_finite(F.col(f))
    marked = rows.withColumn("_again", F.coalesce(before >= F.col("observation_date"), F.lit(False)))
    return marked.groupBy(ID).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("_again").alias("not_increasing"),
        F.count_if(F.coalesce(F.col("realization_date") <= F.col("observation_date"), F.lit(True))).alias("not_ahead"),
        F.count_if(bad).alias("not_finite"),
    )


def require_dataset(rows: DataFrame, features: list[str], instrument: int | str | None = None) -> DataFrame:
    """``rows``, or an error: no feature or two of one name, no rows, another instrument than the one given, or a row that breaks a rule."""
    if not features or len(set(features)) != len(features):
        raise InvalidArgument("features must be named, each by a name of its own")
    report = dataset_report(rows, features)
    wrong = F.lit(False) if instrument is None else F.col(ID) != instrument
    bad = F.count_if((F.col("not_increasing") + F.col("not_ahead") + F.col("not_finite") > 0) | wrong)
    n, broken = report.agg(F.sum("rows"), bad).first()
    if not n or broken:
        raise InvalidData(f"{broken} instruments break a rule" if n else "no rows")
    return rows
