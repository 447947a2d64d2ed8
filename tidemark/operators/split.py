"""Chronological train / validation / test splits with purge and embargo, for all instruments at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, InvalidData
from tidemark.functions.scalars import strict_float64
from tidemark.functions.windows import ID

OBS = "observation_date"
SEGMENTS = ("train", "val", "test")
KEPT, PURGED, EMBARGOED = "kept", "purged", "embargoed"


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.7
    val: float = 0.15
    embargo: int = 0
    purge_overlap: bool = True

    def __post_init__(self) -> None:
        if not isinstance(self.purge_overlap, bool):
            raise InvalidArgument("purge_overlap must be true or false")
        if not (0 < self.train < 1 and 0 < self.val < 1 and self.train + self.val < 1):
            raise InvalidArgument("fractions must be positive and leave a rest for the test segment")
        if isinstance(self.embargo, bool) or not isinstance(self.embargo, int) or self.embargo < 0:
            raise InvalidArgument("embargo must be a number of rows")


def split(rows: DataFrame, config: SplitConfig) -> DataFrame:
    """``rows`` with ``segment`` and ``status`` (kept, purged, embargoed).

    A later segment's row is purged if it is observed before the last realization of what is kept of the earlier ones, unless
    ``purge_overlap`` is off; then the first ``embargo`` of the others are dropped. Dates of an instrument ascend, so purged rows are a prefix and a plain
    filter finds them. All windows share one shuffle by instrument.
    """
    w, whole = Window.partitionBy(ID).orderBy(OBS), Window.partitionBy(ID)
    n, i = F.count(F.lit(1)).over(whole), F.row_number().over(w)
    a, b = F.floor(F.lit(config.train) * n), F.floor(F.lit(config.val) * n)
    out = rows.withColumn("segment", F.when(i <= a, "train").when(i <= a + b, "val").otherwise("test"))
    out = out.withColumn("_bound", F.max(F.when(F.col("segment") == "train", F.col("realization_date"))).over(whole))
    out = _cut(out, "val", config)
    later = F.max(F.when((F.col("segment") == "val") & (F.col("_val") == KEPT), F.col("realization_date"))).over(whole)
    out = _cut(out.withColumn("_bound", F.greatest("_bound", later)), "test", config)
    status = F.when(F.col("segment") == "val", F.col("_val")).when(F.col("segment") == "test", F.col("_test")).otherwise(KEPT)
    return out.withColumn("status", status).drop("_bound", "_val", "_test")


def _cut(rows: DataFrame, segment: str, config: SplitConfig) -> DataFrame:
    early = (F.col(OBS) < F.col("_bound")) & F.lit(config.purge_overlap)
    mine = F.col("segment") == segment
    place = F.count(F.when(mine & ~F.coalesce(early, F.lit(False)), 1)).over(Window.partitionBy(ID).orderBy(OBS).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(f"_{segment}", F.when(~mine, None).when(early, PURGED).when(place <= config.embargo, EMBARGOED).otherwise(KEPT))


def summary(parts: DataFrame) -> DataFrame:
    """Per instrument: rows of each segment and status, the total, and whether a kept segment is empty."""
    n = lambda s, k: F.count_if((F.col("segment") == s) & (F.col("status") == k))
    counted = parts.groupBy(ID).agg(
        F.count(F.lit(1)).alias("total"),
        *[n(s, KEPT).alias(f"{s}_kept") for s in SEGMENTS],
        *[n(s, k).alias(f"{s}_{k}") for s in SEGMENTS[1:] for k in (PURGED, EMBARGOED)],
    )
    return counted.withColumn("rejected", F.least(*[F.col(f"{s}_kept") for s in SEGMENTS]) == 0)


def boundaries(parts: DataFrame) -> DataFrame:
    """Per instrument: first and last observation of each kept segment."""
    kept = lambda s: F.when((F.col("segment") == s) & (F.col("status") == KEPT), F.col(OBS))
    return parts.groupBy(ID).agg(*[f(kept(s)).alias(f"{s}_{n}") for s in SEGMENTS for n, f in (("first", F.min), ("last", F.max))])


def require_complete(parts: DataFrame) -> DataFrame:
    """Strict mode: ``parts``, or an error if an instrument has an empty segment."""
    bad = summary(parts).where("rejected").select(ID).limit(5).collect()
    if bad:
        raise InvalidData(f"empty segments, for instance of instruments {[r[0] for r in bad]}")
    return parts


def verify(parts: DataFrame, source: DataFrame, config: SplitConfig) -> DataFrame:
    """Per instrument: what in ``parts`` differs from what ``config`` makes of ``source``.

    Segments, purge and embargo are derived again from the source, not read from the parts. ``misplaced``: rows in another segment,
    ``misjudged``: rows with another status, ``extra`` and ``missing``: rows that the other side lacks (rows that repeat count),
    ``leaks``: whether a kept row is observed before a realization of an earlier segment's kept rows, while the config forbids it.
    """
    cols = source.columns
    counted = lambda df, names: df.groupBy(*cols).agg(F.count(F.lit(1)).alias(names[0]), F.min("segment").alias(names[1]), F.min("status").alias(names[2]))
    mine = counted(parts, ("n", "s", "k"))
    theirs = counted(split(source, config), ("m", "t", "j"))
    both = mine.join(theirs.select(*[F.col(c).alias(f"_{c}") for c in cols], "m", "t", "j"), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols], "full_outer")
    n, m = F.coalesce("n", F.lit(0)), F.coalesce("m", F.lit(0))
    found = both.withColumn(ID, F.coalesce(ID, f"_{ID}")).groupBy(ID).agg(
        F.sum(n).alias("rows"),
        F.sum(F.greatest(n - m, F.lit(0))).alias("extra"),
        F.sum(F.greatest(m - n, F.lit(0))).alias("missing"),
        F.count_if(F.col("s") != F.col("t")).alias("misplaced"),
        F.count_if(F.col("k") != F.col("j")).alias("misjudged"),
    )
    latest = lambda *segs: F.max(F.when(F.col("segment").isin(*segs) & (F.col("status") == KEPT), F.col("realization_date")))
    first = lambda s: F.min(F.when((F.col("segment") == s) & (F.col("status") == KEPT), F.col(OBS)))
    leak = F.coalesce(first("val") < latest("train"), F.lit(False)) | F.coalesce(first("test") < latest("train", "val"), F.lit(False))
    leaks = parts.groupBy(ID).agg((leak & F.lit(config.purge_overlap)).alias("leaks"))
    return found.join(leaks, ID, "left").withColumn("leaks", F.coalesce("leaks", F.lit(False)))


def require_verified(parts: DataFrame, source: DataFrame, config: SplitConfig) -> DataFrame:
    """``parts``, or an error if they differ in anything from what ``config`` makes of ``source``."""
    bad = verify(parts, source, config).where("leaks or extra + missing + misplaced + misjudged > 0").select(ID).limit(5).collect()
    if bad:
        raise InvalidData(f"the split isn't that of its source, for instance of instruments {[r[0] for r in bad]}")
    return require_complete(parts)


def dense_parts(parts: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """For each segment its kept rows: features as one array of doubles ``x`` in order, and the target ``y``."""
    kept = parts.where(F.col("status") == KEPT).select("segment", ID, OBS, F.array(*[strict_float64(F.col(f), f) for f in features]).alias("x"), strict_float64(F.col("target"), "target").alias("y"))
    return {s: kept.where(F.col("segment") == s).drop("segment") for s in SEGMENTS}
