"""The domain tables, derived from the star schema and event tables by arithmetic that SQL can repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import table

EPOCH, FIRST_DAY, LAST_DAY, SWITCH = "1995-01-01", "1996-01-01", "1997-12-31", "1998-01-01"


def _days(d):
    return F.datediff(d, F.lit(EPOCH).cast("date"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier from line items: ``instrument_id``, ``date``, OHLC, ``volume``.

    First and last go by order, line, part and price (order and line repeat). As one decimal they fit a hash aggregation; a struct
    would need a sort. Digits: 12 for orders, 2 for lines, 12 for parts, 12 for prices in cents.
    """
    li = table(spark, sf_dir, "lineitem")
    whole = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    key = (whole("l_orderkey", 12) * F.lit(100).cast("decimal(3,0)") + whole("l_linenumber", 2)).cast("decimal(14,0)")
    key = (key * F.lit(10**12).cast("decimal(13,0)") + whole("l_partkey", 12)).cast("decimal(26,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(12,0)")
    key = (key * F.lit(10**12).cast("decimal(13,0)") + cents).cast("decimal(38,0)")
    return li.groupBy(F.col("l_suppkey").alias("instrument_id"), F.to_date("l_shipdate").alias("date")).agg(
        F.min_by("l_extendedprice", key).alias("open"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.max_by("l_extendedprice", key).alias("close"),
        F.sum("l_quantity").cast("double").alias("volume"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each user from events."""
    ev = table(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("instrument_id"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", "ts").alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
    )


#: Sessions by exchange number: zone, opening, close. One is overnight.
SESSIONS = (
    ("America/New_York", "09:30", "16:00"), ("Europe/Berlin", "09:00", "17:30"), ("Asia/Kolkata", "09:15", "15:30"),
    ("Australia/Sydney", "10:00", "16:00"), ("America/Chicago", "17:00", "16:00"),
)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exchange's session."""
    n = F.col("n_nationkey")
    kinds = F.array(*[F.struct(*[F.lit(x).alias(c) for x, c in zip(s, ("timezone", "opens", "closes"), strict=True)]) for s in SESSIONS])
    return table(spark, sf_dir, "nation").select(n.alias("exchange_id"), kinds[(n % len(SESSIONS)).cast("int")].alias("s")).select("exchange_id", "s.*")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at instants from events, spread over a year so that daylight saving begins and ends; listings are exchanges by number."""
    ev = table(spark, sf_dir, "events")
    at = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + (F.col("event_id") % 360) * 86_400_000_000)
    return ev.select(F.col("user_id").alias("instrument_id"), (F.col("user_id") % 25).alias("exchange_id"), at.alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("tick_id"))


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        F.col("n_nationkey").alias("exchange_id"), F.upper(F.trim("n_name")).alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("country")
    )


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").alias("instrument_id"),
        F.col("s_nationkey").alias("exchange_id"),
        F.upper(F.trim("s_name")).alias("symbol"),
        F.concat(F.lit("IN"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"), F.when(F.col("s_suppkey") % 3 == 0, "X").otherwise("7")).alias("isin"),
    )


def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holidays of each exchange; days come by expansion of each exchange's row."""
    days = F.sequence(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("exchange_id"), F.explode(days).alias("holiday_date"))
    k = _days(F.col("holiday_date"))
    kind = F.when((k + F.col("exchange_id")) % 3 == 0, "full_day").when((k + F.col("exchange_id")) % 3 == 1, "half_day").otherwise("early_close")
    return n.where((k * 7 + F.col("exchange_id")) % 61 == 0).withColumn("session_type", kind)


def actions_of(b: DataFrame) -> DataFrame:
    """Splits and dividends of bars; some dividends fall a day beside their bar."""
    k, i = _days(F.col("date")), F.col("instrument_id")
    kinds = F.array(
        F.when((k + i * 13) % 181 == 0, F.struct(F.lit("split").alias("action_type"), F.when(i % 2 == 1, 0.5).otherwise(2.0).alias("value"), F.col("date").alias("execution_date"))),
        F.when(
            (k + i * 13) % 41 == 0,
            F.struct(F.lit("dividend").alias("action_type"), (F.floor("close") / 100.0).alias("value"), F.when(i % 10 == 3, F.date_add("date", 1)).otherwise(F.col("date")).alias("execution_date")),
        ),
    )
    return b.select("instrument_id", F.explode(F.array_compact(kinds)).alias("a")).select("instrument_id", "a.action_type", "a.execution_date", "a.value")


def corporate_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_of(bars(spark, sf_dir))


def instrument_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two names of each instrument: until and from ``SWITCH``."""
    d = lambda x: F.lit(x).cast("date")
    two = F.array(
        F.struct(F.concat(F.lit("OLD_"), F.col("symbol")).alias("symbol"), d("1990-01-01").alias("effective_from"), d("1997-12-31").alias("effective_to")),
        F.struct(F.col("symbol").alias("symbol"), d(SWITCH).alias("effective_from"), F.lit(None).cast("date").alias("effective_to")),
    )
    return instruments(spark, sf_dir).select("instrument_id", F.explode(two).alias("h")).select("instrument_id", "h.*")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric for each order priority, by quarter; some are not available yet, some have no fiscal period."""
    o = table(spark, sf_dir, "orders")
    k, end = F.col("instrument_id"), F.col("period_end")
    sums = o.groupBy(
        (F.col("o_custkey") % 50).alias("instrument_id"),
        F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("period_end"),
        F.lower(F.trim("o_orderpriority")).alias("metric_name"),
    ).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return sums.select(
        "instrument_id", "period_end", "metric_name", "value",
        F.when(k % 7 != 0, F.year(end)).cast("int").alias("fiscal_year"),
        F.when(k % 7 != 0, F.quarter(end)).cast("int").alias("fiscal_quarter"),
        F.date_add(end, 15).alias("published_at"),
        F.when(k % 11 != 0, F.date_add(end, (k % 5).cast("int") + 15)).alias("available_at"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingestion runs from events."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("instrument_id"), F.lower(F.trim("event_type")).alias("ingestion_type"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 5 == 0, "FAILED").otherwise("SUCCESS").alias("status"),
    )


def stored_bars(b: DataFrame) -> DataFrame:
    """What the store has: some bars are missing."""
    return b.where((F.col("instrument_id") + _days(F.col("date"))) % 7 != 0)


def incoming_bars(b: DataFrame) -> DataFrame:
    """What arrives: all bars, some with a revised close; the newest arrival of a bar counts."""
    revised = (F.col("instrument_id") + _days(F.col("date"))) % 5 == 0
    once = b.withColumns({"close": F.when(revised, F.col("close") + 1).otherwise(F.col("close")), "arrival": F.lit(1)})
    early = b.where(revised).withColumns({"close": F.col("close") + 5, "arrival": F.lit(0)})
    return once.unionByName(early)
