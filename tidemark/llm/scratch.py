"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it back, so a lost executor costs only
the tasks it ran: nothing is kept on executors (no cache, no local checkpoints).

Operators delete the tables that nothing reads again. What their results still read goes when the driver ends.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import shared_dir, ship

#: Settings while an intermediate table is written: shuffle files go when the table is there; files are of the advised size,
#: not as many as there are cores; batches for Python hold few rows, since a row can be a very long text.
SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}
#: Settings of a session that works on texts: rows can be long, so readers and Python batches are bounded by less than the usual
#: number of rows, and batches by their bytes.
LONG_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(2 << 20)}
_LOCK = threading.Lock()
#: Writers at work in each session, and the settings before the first of them.
_WRITERS: dict[int, tuple[int, dict[str, str | None]]] = {}


def prepare(spark: SparkSession) -> None:
    """Send the package to the executors and bound batches of long rows."""
    ship(spark)
    for k, v in LONG_ROWS.items():
        spark.conf.set(k, v)


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """``SETTINGS`` hold until the last writer of the session is done, whatever thread it runs in."""
    key, conf = id(spark._jsparkSession), spark.conf
    with _LOCK:
        n, was = _WRITERS.get(key, (0, {}))
        if not n:
            was = {k: conf.get(k, None) for k in SETTINGS}
            for k, v in SETTINGS.items():
                conf.set(k, v)
        _WRITERS[key] = n + 1, was
    try:
        yield
    finally:
        with _LOCK:
            n, was = _WRITERS.pop(key)
            if n > 1:
                _WRITERS[key] = n - 1, was
            else:
                for k, v in was.items():
                    conf.unset(k) if v is None else conf.set(k, v)


class Scratch:
    """Tables of one operator run, below a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
        fs, path = self._at(self.root)
        fs.mkdirs(path)  # only what is there can be marked
        fs.deleteOnExit(path)

    def _at(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def write(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        """Write ``df`` as table ``name`` and return it as read back."""
        with _settings(self.spark):
            w = df.write.mode("overwrite")
            (w.partitionBy(partition_by) if partition_by else w).parquet(f"{self.root}/{name}")
        return self.read(name, df)

    def write_bucketed(self, df: DataFrame, name: str, table: str, buckets: int, keys: list[str]) -> None:
        """Write ``df`` in sorted buckets as table ``name``; the session's catalog knows it as ``table``."""
        with _settings(self.spark):
            df.write.bucketBy(buckets, *keys).sortBy(*keys).option("path", f"{self.root}/{name}").mode("overwrite").saveAsTable(table)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing will read again."""
        for name in names:
            fs, path = self._at(f"{self.root}/{name}")
            fs.delete(path, True)
