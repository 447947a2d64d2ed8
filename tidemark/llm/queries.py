"""The registered queries of the operators, with production parameters over whole tables, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat_format, decontamination, fill_middle, fingerprints, jaccard_join, language_id, license_scan, line_dedup, mixing, neighbours, sharding, spelling, url_filter
from tidemark.llm.scratch import Scratch, prepare

CHAT_CASE = "</s>[INST] ok [/INST]"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = _table(spark, sf_dir, "documents"), Scratch(spark, "mixing")
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    sized = scratch.write(sized, "sizes")  # texts are read once
    out = mixing.mix(sized, F.col("source"), F.col("text_hash"), ["doc_id"], F.col("size"), scratch)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, text = _table(spark, sf_dir, "documents"), F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = Scratch(spark, "sharding").write(rows, "rows")  # texts are read once
    out = sharding.shard_rows(rows, ["doc_id", "size", "text_crc32"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    case = spark.range(2).selectExpr("-1L", "id", "if(id = 0, 'user', 'assistant')", f"'{CHAT_CASE}'")
    return chat_format.read_back(chat_format.format_conversations(rows.union(case)))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    rows = docs.select("doc_id", "text", "lang", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    profiles = language_id.learn(rows.where(~F.col("held_out")), "text", "lang")
    return language_id.predict(rows.drop("lang"), "text", profiles).select("doc_id", "held_out", "lang_pred", "score")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("word", "form", "root", "n", "n_near", "form_n")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transform(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    restored = fill_middle.restore(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_line_dedup, op3_url_filter, op4_decontamination, op5_ngram_jaccard_join, op6_fingerprints, op7_mixing, op8_sharding, op9_chat_format, op10_language_id,
        op11_spelling_variants, op12_fill_middle, op13_neighbours,
    )
}

ORACLES = {
    "op1_license_scan": license_scan.oracle(),
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_url_filter": url_filter.oracle(),
    "op4_decontamination": decontamination.ORACLE,
    "op5_ngram_jaccard_join": jaccard_join.ORACLE,
    "op9_chat_format": chat_format.oracle(CHAT_CASE),
    "op12_fill_middle": fill_middle.ORACLE,
}
