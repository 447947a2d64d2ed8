"""Explicit schemas of the domain tables at rest: money as decimals, keys as strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS, _I, _B = T.StringType(), T.DateType(), T.TimestampType(), T.IntegerType(), T.BooleanType()
PRICE, AMOUNT = T.DecimalType(18, 6), T.DecimalType(24, 6)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


TABLES: dict[str, T.StructType] = {
    "exchanges": _table(exchange_id=_S, code=_S, name=_S, country=_S, timezone=_S),
    "companies": _table(company_id=_S, name=_S, legal_name=_S, country=_S),
    "instruments": _table(instrument_id=_S, company_id=_S, exchange_id=_S, symbol=_S, isin=_S, asset_type=_S, status=_S, is_primary_listing=_B),
    "instrument_history": _table(history_id=_S, instrument_id=_S, exchange_id=_S, symbol=_S, effective_from=_D, effective_to=_D, reason=_S),
    "market_holidays": _table(holiday_id=_S, exchange_id=_S, holiday_date=_D, name=_S, session_type=_S),
    "market_bars": _table(market_bar_id=_S, instrument_id=_S, timestamp=_TS, open=PRICE, high=PRICE, low=PRICE, close=PRICE, volume=AMOUNT),
    "corporate_actions": _table(corporate_action_id=_S, instrument_id=_S, action_type=_S, execution_date=_D, value=AMOUNT, currency=_S, description=_S),
    "fundamental_records": _table(
        fundamental_record_id=_S, instrument_id=_S, period_end=_D, metric_name=_S, value=AMOUNT, fiscal_year=_I, fiscal_quarter=_I, currency=_S, published_at=_TS, available_at=_TS
    ),
    "ingestion_runs": _table(
        run_id=_S, instrument_id=_S, ingestion_type=_S, provider=_S, started_at=_TS, completed_at=_TS, status=_S,
        received_count=_I, inserted_count=_I, updated_count=_I, skipped_count=_I, error_message=_S,
    ),
}
#: Keys that a table holds once.
KEYS: dict[str, list[str]] = {
    "exchanges": ["code"],
    "companies": ["company_id"],
    "instruments": ["instrument_id"],
    "instrument_history": ["history_id"],
    "ingestion_runs": ["run_id"],
    "market_holidays": ["exchange_id", "holiday_date"],
    "market_bars": ["instrument_id", "timestamp"],
    "corporate_actions": ["instrument_id", "execution_date", "action_type"],
    "fundamental_records": ["instrument_id", "period_end", "metric_name", "fiscal_year", "fiscal_quarter"],
}
#: Columns that a row keeps once it has them.
SURROGATES: dict[str, str] = {
    "exchanges": "exchange_id",
    "market_holidays": "holiday_id",
    "market_bars": "market_bar_id",
    "corporate_actions": "corporate_action_id",
    "fundamental_records": "fundamental_record_id",
}


@dataclass(frozen=True)
class Part:
    """Which partition a row is in: the month or year of a key column, or one of ``buckets`` by its hash."""

    column: str
    kind: str = "bucket"
    buckets: int = 16

    def of(self) -> Column:
        c = F.col(self.column)
        if self.kind == "bucket":
            return F.lpad(F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("string"), 4, "0")
        return F.coalesce(F.date_format(c, {"month": "yyyy-MM", "year": "yyyy"}[self.kind]), F.lit("none"))


#: Partitions of the tables at rest.
PARTS: dict[str, Part] = {
    "exchanges": Part("code", buckets=1),
    "companies": Part("company_id"),
    "instruments": Part("instrument_id"),
    "instrument_history": Part("history_id"),
    "ingestion_runs": Part("run_id"),
    "market_holidays": Part("holiday_date", "year"),
    "market_bars": Part("timestamp", "month"),
    "corporate_actions": Part("execution_date", "year"),
    "fundamental_records": Part("period_end", "year"),
}
