"""Folders in the file system that the cluster shares, through Hadoop's interface, so that any store does."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from tidemark.session import shared_dir


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def any_folder(spark: SparkSession, pattern: str) -> bool:
    """Whether a path fits the pattern."""
    fs, at = _at(spark, pattern)
    return bool(fs.globStatus(at))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what is in a folder; nothing if there is none."""
    fs, at = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files; 0 if there is none."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength() if fs.exists(at) else 0


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def temporary_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex[:12]}"
    fs, at = _at(spark, path)
    fs.mkdirs(at)  # only what is there can be marked
    fs.deleteOnExit(at)
    return path
