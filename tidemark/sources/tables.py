"""Readers with explicit schemas; providers are in ``sources.provider``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import check_range, upper_code
from tidemark.schemas import TABLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_domain(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A domain table with its fixed schema: nothing is inferred."""
    return spark.read.schema(TABLES[name]).format(fmt).load(path)


#: Suffixes of provider tickers by exchange (fixed values).
TICKER_SUFFIX = {"NSE": ".NS", "BSE": ".BO"}


def provider_ticker(symbol: Column, exchange: Column, strict: bool = True) -> Column:
    """Ticker at the provider; other exchanges raise, or give null if not ``strict``."""
    code = upper_code(exchange)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, suffix in TICKER_SUFFIX.items():
        out = out.when(code == name, F.concat(upper_code(symbol), F.lit(suffix)))
    return out.otherwise(F.raise_error(F.concat(F.lit("no provider ticker for exchange "), code))) if strict else out


def unpivot_fundamentals(wide: DataFrame, ids: list[str], metrics: list[str], start: str, end: str) -> DataFrame:
    """Long rows (metric_name, value) of a wide table whose ``period_end`` is in the range; null and NaN are left out."""
    check_range(start, end)
    kept = wide.where(F.col("period_end").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return kept.unpivot(ids, metrics, "metric_name", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
