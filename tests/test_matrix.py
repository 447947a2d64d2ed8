"""Matrices on disk are the datasets they come from, bit by bit."""

import datetime as dt
import random
import zlib

import numpy as np
import pytest

from tidemark.errors import InvalidArgument
from tidemark.operators import matrix

SCHEMA = "instrument_id long, observation_date date, segment string, a double, b decimal(18,6), target double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(7):
        for k in range(rng.randrange(1, 400)):
            out.append((i, dt.date(2020, 1, 1) + dt.timedelta(days=k), ("train", "val", "test")[min(2, k // 100)], rng.choice([rng.random(), -0.0, 5e-324, 1.7e308, -1e-300]), rng.randrange(10**9) / 10**6, rng.random()))
    return out


@pytest.mark.parametrize("block_rows", [1, 37, 10_000])
def test_files_hold_the_rows_in_order(spark, tmp_path, rows, block_rows):
    if block_rows == 1:
        rows = rows[:60]
    from decimal import Decimal

    df = spark.createDataFrame([(*r[:4], Decimal(str(r[4])), r[5]) for r in rows], SCHEMA).repartition(5)
    index = matrix.write_matrix(df, ["a", "b"], str(tmp_path / "m"), segment="segment", block_rows=block_rows).orderBy("segment", "first_row").collect()
    assert all(r["rows"] <= block_rows and r["cols"] == 2 for r in index)
    files = matrix.export_files(matrix.read_matrix(spark, str(tmp_path / "m")), (tmp_path / "files").as_uri())
    named = files.orderBy("segment", "first_row").collect()
    assert [(r["segment"], r["first_row"], r["rows"]) for r in named] == [(r["segment"], r["first_row"], r["rows"]) for r in index]
    assert sorted(p.name for p in (tmp_path / "files").iterdir()) == sorted(f"{r['name']}.{k}" for r in named for k in "xy")
    for s in {r[2] for r in rows}:
        own = sorted(r for r in rows if r[2] == s)
        x = np.array([[r[3], r[4]] for r in own])
        at = 0
        for f, i in ((f, i) for f, i in zip(named, index, strict=True) if f["segment"] == s):
            assert i["first_row"] == at
            block = np.memmap(tmp_path / "files" / f"{f['name']}.x", "<f8", "r").reshape(-1, 2)
            y = np.memmap(tmp_path / "files" / f"{f['name']}.y", "<f8", "r")
            assert block.tobytes() == x[at : at + len(block)].tobytes() and y.tolist() == [r[5] for r in own[at : at + len(block)]]
            assert i["crc32"] == zlib.crc32(y.tobytes(), zlib.crc32(block.tobytes()))
            assert (i["first_id"], i["first_date"], i["last_date"]) == (str(own[at][0]), str(own[at][1]), str(own[at + len(block) - 1][1]))
            at += len(block)
        assert at == len(own)


def test_what_no_double_holds_is_refused(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), "train", 1.0, None, 1.0)], SCHEMA)
    for cols, target in ((["b"], "target"), (["a"], "b")):
        with pytest.raises(Exception, match="b has no value as a double: null"):
            matrix.write_matrix(df, cols, str(tmp_path / "bad"), target=target)
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="a has no value as a double"):
            matrix.write_matrix(spark.createDataFrame([(1, dt.date(2020, 1, 1), "train", bad, None, 1.0)], SCHEMA), ["a"], str(tmp_path / "bad"))
    with pytest.raises(InvalidArgument):
        matrix.write_matrix(df, [], str(tmp_path / "bad"))


def test_no_target_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), "train", 1.5, None, None)], SCHEMA)
    (r,) = matrix.write_matrix(df, ["a"], str(tmp_path / "one"), target=None).collect()
    assert (r["segment"], r["rows"], r["first_row"]) == ("all", 1, 0)
    (b,) = matrix.read_matrix(spark, str(tmp_path / "one")).collect()
    assert matrix.as_numpy(bytes(b["x"]), 1).tolist() == [[1.5]] and not b["y"]
    assert matrix.write_matrix(df.limit(0), ["a"], str(tmp_path / "none")).count() == 0


def test_containers_are_checked(spark, tmp_path, rows):
    """Arrays are read-only, contiguous doubles; what is damaged on the way is found."""
    from decimal import Decimal

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(*r[:4], Decimal(str(r[4])), r[5]) for r in rows], SCHEMA).repartition(3)
    at = str(tmp_path / "m")
    matrix.write_matrix(df, ["a", "b"], at, segment="segment", block_rows=50)
    check = lambda p, source=df: {r["segment"]: tuple(r[c] for c in ("rows", "misshapen", "damaged", "gaps", "not_finite", "differs")) for r in matrix.verify_matrix(spark, p, source, ["a", "b"], segment="segment").collect()}
    n = {s: sum(r[2] == s for r in rows) for s in ("train", "val", "test")}
    assert check(at) == {s: (k, 0, 0, 0, 0, False) for s, k in n.items()}
    assert check(at, df.where("segment <> 'val' or a <> target"))["train"][-1] is False and check(at, df.withColumn("b", F.col("b") + 1))["val"][-1] is True
    (b,) = matrix.read_matrix(spark, at).where("segment = 'train' and first_row = 0").collect()
    x = matrix.as_numpy(bytes(b["x"]), 2)
    assert x.dtype == np.float64 and x.flags.c_contiguous and not x.flags.writeable and x.shape == (50, 2)

    def tampered(name, change):
        to = str(tmp_path / name)
        change(spark.read.parquet(f"{at}/blocks")).write.parquet(f"{to}/blocks")
        spark.read.parquet(f"{at}/index").write.parquet(f"{to}/index")
        return check(to)

    head = F.col("seq") == spark.read.parquet(f"{at}/blocks").where("segment = 'val'").agg(F.min("seq")).first()[0]
    one = (F.col("segment") == "val") & head
    flipped = tampered("flipped", lambda d: d.withColumn("x", F.when(one, F.concat(F.unhex(F.lit("01" * 8)), F.expr("substring(x, 9)"))).otherwise(F.col("x"))))
    assert flipped["val"][2] >= 1 and flipped["val"][-1] and flipped["train"] == (n["train"], 0, 0, 0, 0, False)
    short = tampered("short", lambda d: d.withColumn("x", F.when(one, F.expr("substring(x, 9)")).otherwise(F.col("x"))))
    assert short["val"][1] >= 1 and short["val"][2] >= 1 and short["val"][-1]
    lost = tampered("lost", lambda d: d.where(~one))
    assert lost["val"][3] >= 1 and lost["val"][-1] and lost["test"][3] == 0
    odd = tampered("odd", lambda d: d.withColumn("x", F.when(one, F.concat(F.unhex(F.lit("000000000000F07F")), F.expr("substring(x, 9)"))).otherwise(F.col("x"))))
    assert odd["val"][4] >= 1
