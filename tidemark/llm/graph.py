"""Connected components in Spark by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import Scratch

#: Rounds grow with the logarithm of the longest path; as many would do for more nodes than there are numbers for them.
MAX_ROUNDS = 128


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``node`` and ``component`` (the least node of its component) for every node that has an edge.

    ``edges``: long columns ``a`` and ``b``; repeated edges, loops and an empty table are allowed. A round is two aggregations
    and two joins; each is written to the shared folder, so lineage stays short. Stars with very many leaves are split by
    adaptive execution, since nothing above the joins needs their keys together.

    The rounds end when all that is left are stars, which is tested exactly: every node points to one node, and no node
    that is pointed to points to another. Edges go to smaller nodes and components are kept, so a star's centre is its least node.
    """
    cur = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc0")
    for i in range(1, MAX_ROUNDS + 1):
        if _stars(cur):
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Large star points to smaller nodes only, so a node's neighbours here are all below it.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = scratch.write(below.unionByName(least.withColumnRenamed("m", "v")).distinct(), f"cc{i}")
        scratch.drop(f"cc{i - 1}")
        cur = nxt
    else:
        raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether each node points to one node only, and to none that points to another."""
    out = edges.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    ends = edges.select(F.col("v").alias("u")).distinct()
    return out.join(ends.withColumn("end", F.lit(True)), "u", "left").where("a < b or end").isEmpty()
