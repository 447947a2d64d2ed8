"""Long series in blocks: an instrument's rows are dealt by position to blocks, each with the rows around it that windows look at.

A window needs an instrument's rows in one task. Where one instrument has very many (minute bars of years, ticks), they are dealt to blocks of
about ``rows`` rows instead, and the rows before and after a block are copied along (its halo). Windows then go by (instrument, block) and
give the same, since they see as many rows on either side as they look at.

How many rows lie where is a histogram: instruments of more than ``rows`` rows get narrow spans of time, whose counts add up to positions.
Whole spans are dealt and copied, so the rows themselves are shuffled once, by (instrument, block). Counts don't depend on the order of
rows, so a task that runs again deals them alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.windows import DATE, ID

BLOCK, OWN = "_block", "_own"
#: Spans of time to a block: as many as this if rows are spread evenly over time.
SPANS = 64


def _micros(order: str) -> Column:
    return F.unix_micros(F.col(order).cast("timestamp"))


def deal(bars: DataFrame, rows: int, before: int = 0, after: int = 0, order: str = DATE) -> DataFrame:
    """``bars`` with ``_block`` and ``_own``: own rows are in one block each, copies of halo rows aren't own.

    A block holds the rows of whole spans, so about ``rows``; a span of time that alone has more is a block of its own. Each block's first own
    row has at least ``before`` rows before it, and its last ``after`` rows after it, or all that there are.
    """
    if rows < max(1, before, after):
        raise InvalidArgument(f"a block must hold at least {max(1, before, after)} rows")
    t = _micros(order)
    ends = bars.groupBy(ID).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_low"), F.max(t).alias("_high")).where(F.col("_n") > rows)
    wide = F.ceil((F.col("_high") - F.col("_low") + 1) / F.ceil(F.col("_n") * SPANS / rows))
    long = ends.select(F.col(ID).alias("_id"), "_low", wide.alias("_wide"))
    # Other instruments are one block.
    keyed = bars.join(long, F.col(ID) == F.col("_id"), "left").withColumn("_span", F.floor((t - F.col("_low")) / F.col("_wide"))).drop("_id", "_low", "_wide")
    spans = keyed.where("_span is not null").groupBy(F.col(ID).alias("_id"), F.col("_span").alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy("_id").orderBy("_at")
    spans = spans.withColumn("_end", F.sum("_n").over(own)).withColumn("_begin", F.col("_end") - F.col("_n"))
    # Counts of spans are positive, so begins and ends ascend with time and a window by either needs no other sort key.
    spans = spans.withColumn("_mine", F.dense_rank().over(Window.partitionBy("_id").orderBy(F.floor(F.col("_begin") / rows))) - 1)
    # A span's rows are also the halo of the blocks that begin less than ``before`` rows after its end, and end less than ``after`` before its begin.
    ahead = F.max("_mine").over(Window.partitionBy("_id").orderBy("_begin").rangeBetween(0, max(before - 1, 0)))
    behind = F.min("_mine").over(Window.partitionBy("_id").orderBy("_end").rangeBetween(-max(after - 1, 0), 0))
    spans = spans.withColumns({"_ahead": ahead, "_behind": behind})
    last = F.coalesce(F.lead("_ahead").over(own), F.col("_mine")) if before else F.col("_mine")
    first = F.coalesce(F.lag("_behind").over(own), F.col("_mine")) if after else F.col("_mine")
    spans = spans.select("_id", "_at", "_mine", F.sequence(first, last).alias("_blocks"))
    met = keyed.join(spans, (F.col(ID) == F.col("_id")) & (F.col("_span") == F.col("_at")), "left")
    met = met.withColumn(BLOCK, F.explode(F.coalesce("_blocks", F.array(F.lit(0)))))
    return met.withColumn(OWN, F.col(BLOCK) == F.coalesce("_mine", F.lit(0))).drop("_id", "_at", "_span", "_mine", "_blocks")
