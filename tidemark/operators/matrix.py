"""Hand-off of datasets as matrices: contiguous blocks of doubles by segment, in order, with the row at which each begins.

Rows are range-partitioned by segment, instrument and date, so a task packs a run of the whole order and no segment is gathered in one place. Blocks are
a Parquet table (``x``: rows times columns of doubles, row by row, little-endian; ``y``: the target), and an index says where in its segment each
begins: a running count over the blocks' numbers, not over rows. What no double holds (null, not finite, out of range) is refused when it is packed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.scalars import strict_float64
from tidemark.functions.windows import ID

OBS = "observation_date"
BLOCK_ROWS = 65_536
_BLOCKS = "segment string, part int, seq int, rows long, cols int, first_id string, first_date string, last_id string, last_date string, crc32 long, x binary, y binary"


def as_numpy(data: bytes, cols: int) -> np.ndarray:
    """A block's bytes as a matrix, without a copy."""
    return np.frombuffer(data, "<f8").reshape(-1, cols)


def _packer(cols: int, block_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size, segment = 0, None

        def block() -> pa.RecordBatch:
            nonlocal held, size, seq
            t = pa.Table.from_batches(held)
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t["x"].chunks]).astype("<f8").tobytes()
            y = t["y"].to_numpy().astype("<f8").tobytes() if t["y"].null_count == 0 else b""
            crc = zlib.crc32(y, zlib.crc32(x))
            ends = [t[c][i].as_py() for i in (0, t.num_rows - 1) for c in ("key", "day")]
            row = [segment, part, seq, t.num_rows, cols, *ends, crc, x, y]
            names = [n.split()[0] for n in _BLOCKS.split(", ")]
            types = {"part": pa.int32(), "seq": pa.int32(), "cols": pa.int32(), "x": pa.binary(), "y": pa.binary()}
            held, size, seq = [], 0, seq + 1
            return pa.RecordBatch.from_arrays([pa.array([v], types.get(n)) for n, v in zip(names, row, strict=True)], names)

        for batch in batches:
            marks = batch["segment"].to_pylist()
            cuts = [0, *(i for i in range(1, len(marks)) if marks[i] != marks[i - 1]), len(marks)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and marks[a] != segment:
                    yield block()
                segment, rest = marks[a], batch.slice(a, b - a)
                while size + rest.num_rows >= block_rows:
                    held.append(rest.slice(0, block_rows - size))
                    rest = rest.slice(block_rows - size)
                    yield block()
                if rest.num_rows:
                    held.append(rest)
                    size += rest.num_rows
        if held:
            yield block()

    return run


def write_matrix(rows: DataFrame, features: list[str], path: str, segment: str | None = None, target: str | None = "target", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write ``rows`` (of a dataset, with a ``segment`` column or as one segment) below ``path``; returns the index.

    The index has a row for each block: its place among the blocks, the row of its segment at which it begins, rows and columns, the keys of its first and last
    row, and the checksum of its bytes.
    """
    if not features or block_rows < 1:
        raise InvalidArgument("a matrix has columns, and blocks have rows")
    spark = rows.sparkSession
    own = F.col(segment).cast("string") if segment else F.lit("all")
    y = strict_float64(F.col(target), target) if target else F.lit(None).cast("double")
    flat = rows.select(own.alias("segment"), ID, OBS, F.array(*[strict_float64(F.col(f), f) for f in features]).alias("x"), y.alias("y"))
    ordered = flat.repartitionByRange("segment", ID, OBS).sortWithinPartitions("segment", ID, OBS)
    packed = ordered.select("segment", F.col(ID).cast("string").alias("key"), F.col(OBS).cast("string").alias("day"), "x", "y").mapInArrow(_packer(len(features), block_rows), _BLOCKS)
    packed.write.mode("overwrite").parquet(f"{path}/blocks")  # so that ranges are drawn once
    numbers = spark.read.schema(packed.schema).parquet(f"{path}/blocks").drop("x", "y")
    before = F.sum("rows").over(Window.partitionBy("segment").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    numbers.withColumn("first_row", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with their ``first_row``."""
    index = spark.read.parquet(f"{path}/index").select("segment", "part", "seq", "first_row")
    return spark.read.parquet(f"{path}/blocks").join(index, ["segment", "part", "seq"])


def export_files(blocks: DataFrame, folder: str) -> DataFrame:
    """Write each block of ``read_matrix`` as files that can be mapped (``segment-first_row.x`` and ``.y``); returns their names, rows and columns.

    ``folder`` is a URI of a file system that all executors can write. A file is complete when it has its name, so a task that runs again only writes it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            names = []
            for r in batch.to_pylist():
                name = f"{r['segment']}-{r['first_row']:015d}"
                for kind in ("x", "y"):
                    with store.open_output_stream(f"{at}/_{name}.{kind}-{attempt}") as out:
                        out.write(r[kind])
                    store.move(f"{at}/_{name}.{kind}-{attempt}", f"{at}/{name}.{kind}")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names), *[batch[c] for c in ("segment", "first_row", "rows", "cols")]], ["name", "segment", "first_row", "rows", "cols"])

    return blocks.select("segment", "first_row", "rows", "cols", "x", "y").mapInArrow(run, "name string, segment string, first_row long, rows long, cols int")


def _unpacked(blocks: DataFrame) -> DataFrame:
    """Rows of blocks: ``segment``, ``x`` and ``y``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                flat, n, cols = np.frombuffer(r["x"], "<f8"), r["rows"], r["cols"]
                x = pa.ListArray.from_arrays(pa.array(np.arange(0, n * cols + 1, cols, dtype=np.int32)), pa.array(flat[: n * cols]))
                y = pa.array(np.frombuffer(r["y"], "<f8")) if r["y"] else pa.nulls(n, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array([r["segment"]] * n), x, y], ["segment", "x", "y"])

    return blocks.select("segment", "rows", "cols", "x", "y").mapInArrow(run, "segment string, x array<double>, y double")


def verify_matrix(spark: SparkSession, path: str, rows: DataFrame, features: list[str], segment: str | None = None, target: str | None = "target") -> DataFrame:
    """Per segment: ``rows``, and what is wrong with the blocks below ``path``, which are to hold ``rows``.

    ``misshapen``: blocks whose bytes aren't rows times columns of doubles; ``damaged``: blocks whose bytes don't have their checksum; ``gaps``: blocks that don't begin where
    the one before ends, or are out of the index; ``not_finite``: values; ``differs``: whether the values, row by row, aren't those of the source.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    index = spark.read.parquet(f"{path}/index")
    good = (F.length("x") == F.col("rows") * F.col("cols") * 8) & ((F.length("y") == F.col("rows") * 8) | (F.length("y") == 0))
    sound = F.crc32(F.concat("x", "y")) == F.col("crc32")
    shape = blocks.groupBy("segment").agg(F.sum("rows").alias("rows"), F.count_if(~good).alias("misshapen"), F.count_if(~sound).alias("damaged"))
    there = index.join(blocks.select("segment", "part", "seq", F.lit(True).alias("here")), ["segment", "part", "seq"], "full_outer")
    after = F.lag(F.col("first_row") + F.col("rows"), 1, 0).over(Window.partitionBy("segment").orderBy("first_row"))
    gaps = there.withColumn("_after", after).groupBy("segment").agg(F.count_if(F.coalesce((F.col("first_row") != F.col("_after")) | F.col("here").isNull(), F.lit(True))).alias("gaps"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    source = rows.select((F.col(segment).cast("string") if segment else F.lit("all")).alias("segment"), x.alias("x"), (F.col(target) if target else F.lit(None)).cast("double").alias("y"))
    mark = F.sum(F.xxhash64("x", F.coalesce("y", F.lit(0.0))).cast("decimal(38,0)"))  # of rows in any order: equal if the rows are
    finite = lambda c: F.col(c).isNull() | (~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    bad = F.exists("x", lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))) | ~finite("y")
    mine = _unpacked(blocks.where(good)).groupBy("segment").agg(mark.alias("m"), F.count_if(bad).alias("not_finite"))
    both = mine.join(source.groupBy("segment").agg(mark.alias("s")), "segment", "full_outer")
    out = shape.join(gaps, "segment", "full_outer").join(both, "segment", "full_outer")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("rows", "misshapen", "damaged", "gaps", "not_finite")}
    return out.withColumns(zero | {"differs": ~F.col("m").eqNullSafe(F.col("s"))}).drop("m", "s")


def column_sums(blocks: DataFrame) -> DataFrame:
    """Each block's columns and target summed, from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [as_numpy(x, c).sum(axis=0).tolist() for x, c in zip(batch["x"].to_pylist(), batch["cols"].to_pylist(), strict=True)]
            ys = [float(np.frombuffer(y, "<f8").sum()) for y in batch["y"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in ("segment", "first_row", "rows", "cols")], pa.array(sums, pa.list_(pa.float64())), pa.array(ys, pa.float64())], ["segment", "first_row", "rows", "cols", "sums", "y"])

    return blocks.select("segment", "first_row", "rows", "cols", "x", "y").mapInArrow(run, "segment string, first_row long, rows long, cols int, sums array<double>, y double")
