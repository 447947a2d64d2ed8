"""Session settings that the library relies on, and shipping of its code to executors."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

from tidemark.errors import InvalidArgument

_SHIPPED: set[str] = set()


def build_session(app: str = "tidemark", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings as keywords with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings |= {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session names it. On a single machine, where none is set, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


@contextmanager
def shuffles_freed(*sessions: SparkSession) -> Iterator[None]:
    """Files of a shuffle go when the job that has them is done; otherwise they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = [(s, s.conf.get(key, None)) for s in sessions]
    for s in sessions:
        s.conf.set(key, "true")
    try:
        yield
    finally:
        for s, was in reversed(before):
            s.conf.unset(key) if was is None else s.conf.set(key, was)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidemark-")) / "tidemark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)
