"""Slowly changing identity of instruments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import is_isin, upper_code
from tidemark.functions.windows import ID

#: Life cycle of an instrument (fixed values).
STATUSES = ("active", "inactive", "suspended", "delisted")


def register_instruments(new: DataFrame, instruments: DataFrame, companies: DataFrame, exchanges: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """Rows to add to the instruments and to their history for ``new`` (instrument, company_id, code, symbol, isin).

    Codes and symbols are normalised, instruments begin as active and their first name is valid from ``on`` on. An unknown company or
    exchange, an ISIN of another form, or an instrument that is there already raises.
    """
    known = companies.select("company_id", F.lit(True).alias("_company")).distinct()
    places = exchanges.select(F.col("code").alias("_code"), "exchange_id")
    there = instruments.select(ID, F.lit(True).alias("_there")).distinct()
    rows = new.join(known, "company_id", "left").join(places, upper_code(F.col("code")) == F.col("_code"), "left").join(there, ID, "left")
    wrong = (
        F.when(F.col("_there"), "is there already").when(F.col("_company").isNull(), "has an unknown company")
        .when(F.col("exchange_id").isNull(), "has an unknown exchange").when(~F.coalesce(is_isin(F.col("isin")), F.lit(False)), "has no valid ISIN")
    )
    checked = F.when(wrong.isNull(), upper_code(F.col("symbol"))).otherwise(F.raise_error(F.concat(F.lit("instrument "), F.col(ID).cast("string"), F.lit(" "), wrong)))
    rows = rows.withColumns({"symbol": checked, "isin": upper_code(F.col("isin")), "status": F.lit(STATUSES[0])})
    history = rows.select(ID, "exchange_id", "symbol", F.lit(on).cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    return rows.select(ID, "company_id", "exchange_id", "symbol", "isin", "status"), history


def change_symbols(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History after ``changes`` (instrument, new_symbol, effective): open rows end the day before, new rows are open.

    Several changes of one instrument follow each other by date: each ends the one before. A change on or before the day the row
    before it begins would end that before it starts and raises, as does one without a date.
    """
    by_date = Window.partitionBy(ID).orderBy("effective")
    dated = F.coalesce("effective", F.raise_error(F.lit("a change has no date")).cast("date"))
    c = changes.select(ID, upper_code(F.col("new_symbol")).alias("new_symbol"), dated.alias("effective"))
    c = c.withColumns({"_next": F.lead("effective").over(by_date), "_n": F.row_number().over(by_date)})
    late = F.raise_error(F.lit("the change takes effect before the open row begins")).cast("date")
    day_before = lambda after, start: F.when(after > start, F.date_sub(after, 1)).otherwise(late)
    first = c.where("_n = 1").select(ID, F.col("effective").alias("_effective"))
    hit = F.col("effective_to").isNull() & F.col("_effective").isNotNull()
    joined = history.join(first, ID, "left")
    closed = joined.withColumn("effective_to", F.when(hit, day_before(F.col("_effective"), F.col("effective_from"))).otherwise(F.col("effective_to")))
    end = F.when(F.col("_next").isNotNull(), day_before(F.col("_next"), F.col("effective")))
    opened = joined.where(hit).drop("symbol", "effective_from", "effective_to", "_effective").join(c, ID)
    opened = opened.select(*[{"symbol": F.col("new_symbol"), "effective_from": F.col("effective"), "effective_to": end}.get(n, F.col(n)).alias(n) for n in history.columns])
    return closed.select(*history.columns).unionByName(opened)


def current_symbols(instruments: DataFrame, changes: DataFrame) -> DataFrame:
    """Instruments with the newest of their changed symbols."""
    c = changes.groupBy(ID).agg(F.max_by(upper_code(F.col("new_symbol")), "effective").alias("_new"))
    return instruments.join(c, ID, "left").withColumn("symbol", F.coalesce("_new", "symbol")).drop("_new")


def set_status(instruments: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply ``changes`` (instrument, new_status); a status out of the life cycle raises."""
    new = F.lower(F.trim("new_status"))
    c = changes.select(ID, F.when(new.isin(*STATUSES), new).otherwise(F.raise_error(F.concat(F.lit("unknown status "), new))).alias("_new"))
    return instruments.join(c, ID, "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")
