"""Registered queries take whole tables: their registered SQL, which has no id filter, gives the same rows."""

import datetime as dt

import duckdb
import pytest

from tidemark.operators import quality
from tidemark.plans import catalog

SF = "/root/testdata/sf0.01"


def plain(name):
    db = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = db.execute(catalog.ORACLES[name])
    return [c[0] for c in found.description], found.fetchall()


@pytest.mark.parametrize("name", ["fundamentals_asof_join", "dq_bar_batch"])
def test_whole_tables(spark, name):
    assert "instrument_id < 50" not in catalog.ORACLES[name] and "user_id < 10" not in catalog.ORACLES[name]
    columns, expected = plain(name)
    got = [tuple(r) for r in catalog.QUERIES[name](spark, SF).select(columns).collect()]
    assert len(got) == len(expected) and set(got) == set(expected)


def test_fundamental_batch_of_another_instrument(spark):
    d = dt.date
    rows = [(1, d(2024, 3, 31)), (2, d(2024, 3, 31)), (2, d(2030, 3, 31)), (1, d(2030, 3, 31))]
    r = spark.createDataFrame([(*x, "revenue", 2024, 1) for x in rows], "instrument_id long, period_end date, metric_name string, fiscal_year int, fiscal_quarter int")
    got = {(x[0], x[1]): x["violation"] for x in quality.fundamental_batch(r, "2024-01-01", "2024-12-31", 1).collect()}
    assert got == {rows[1]: "wrong_instrument", rows[2]: "wrong_instrument", rows[3]: "out_of_range"}
