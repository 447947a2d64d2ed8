"""The corpus pipeline: documents through language ID, near-duplicate removal, decontamination, mixing and sharding.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and gives the
table as read back to the next stage. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, jaccard_join, language_id, mixing, sharding
from tidemark.llm.scratch import Scratch, prepare

#: Near duplicates: five-word shingles, Jaccard similarity of 80 percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts in no language: null, or without a letter. Where nothing could be learned, all others pass as of one language."""
    prepare(spark)
    profiles = language_id.learn(docs, "text", "lang") or {"unknown": np.zeros(1, np.uint32)}
    rows = docs.select(F.struct("*").alias("row"))  # so that no column's name can clash
    return language_id.predict(rows, "row.text", profiles).where(F.col("lang_pred") != language_id.UND).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of similar texts, the one of the least ``doc_id`` (null last), once.

    Texts without words are no copies of each other. Rows that repeat an id and its text stay once. What goes is listed by id and hash
    of the text: a broadcast up to a checked number, a shuffle beyond.
    """
    prepare(spark)
    scratch = Scratch(spark, "near")
    parts = jaccard_join.components(docs, SHINGLE_WORDS, SIMILAR_PERCENT)
    key = ["nd_id", "nd_none", "nd_t"]
    keyed = lambda ident, t: [F.coalesce(ident, F.lit(0)).alias(key[0]), ident.isNull().alias(key[1]), t.alias(key[2])]
    parts = scratch.write(parts.select(*keyed(F.col("doc_id"), F.col("text_hash")), "representative"), "parts")
    listed = lambda df, name: scratch.write(df.select(*key), name)
    gone = listed(parts.where("not representative").distinct(), "gone")
    again = listed(parts.where("representative").groupBy(*key).count().where("count > 1"), "again")
    rows = docs.select(F.struct("*").alias("nd_row"), *keyed(F.col("doc_id").cast("long"), F.xxhash64("text")))
    spread = lambda df: F.broadcast(df) if df.count() <= jaccard_join.MAX_SPREAD_IDS else df
    kept = rows.join(spread(gone), key, "left_anti")
    if not again.isEmpty():
        once = kept.join(spread(again), key, "left_semi").dropDuplicates(key)
        kept = kept.join(spread(again), key, "left_anti").unionByName(once)
    return kept.select("nd_row.*")


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that share ten words in a row with the benchmark."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix says: not at all, once, or repeated. Equal rows are taken alike; an empty table stays empty."""
    prepare(spark)
    scratch = Scratch(spark, "mixing")
    keyed = lambda size, *kept: mixing.numbers(docs.select(*kept, "doc_id", "source", "text"), F.col("source"), F.col("text"), ["doc_id"], size)
    sized = scratch.write(keyed(mixing.word_count(F.col("text"))).drop("doc_id", "source", "text"), "sized")  # the mix reads numbers only
    taken = mixing.solve(sized, scratch).apply(keyed(None, F.struct(*docs.columns).alias("_mx_row")).drop("doc_id", "source", "text"))
    taken = taken.where("_mx_copies > 0").withColumn("_mx_copy", F.explode(F.sequence(F.lit(1), F.col("_mx_copies"))))
    return taken.select("_mx_row.*")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals documents to shards of equal size in a uniformly random order: ``shard`` and ``slot`` (these replace columns of their names)."""
    prepare(spark)
    return sharding.shard_rows(docs, ["doc_id", F.xxhash64("text")], shards=SHARDS).select(*[c for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can't express the stages that draw from seeded hashes; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
