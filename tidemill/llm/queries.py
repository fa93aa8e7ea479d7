"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, licences, rules
from .decontaminate import contamination
from .mixing import mix
from .neardup import near_duplicates
from .oracles import ORACLE_SQL as WHOLE_SQL
from .quality import ORACLE as QUALITY_SQL
from .quality import score
from .shared import table
from .sharding import assign_shards
from .substrings import dedup_words
from .suffixdedup import dedup_bytes


def op1_prefix_sum_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = assign_shards(table(spark, sf_dir, "documents"), n_shards=40, overhead=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85, width=5).select("doc_id", "n_shingles", "component_id", "kept")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = (table(spark, sf_dir, n) for n in ("documents", "benchmark"))
    out = contamination(docs.select("doc_id", "text"), bench, window=10, into="c")
    return out.select("doc_id", "c.n_words", "c.n_hit", "c.n_items", F.sha2(F.concat_ws(",", "c.items").cast("binary"), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), width=200)
    return out.select("doc_id", F.col("dedup.n_units").alias("n_bytes"), "dedup.n_removed", "dedup.n_spans", F.sha2("dedup.kept", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.fold("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    c = F.col("licences")
    return out.select("doc_id", c["n_words"].alias("n_words"), c["n_base"].alias("n_base"), c["first_word"].alias("first_word"), c["last_word"].alias("last_word"), F.concat_ws(",", c["base_labels"]).alias("base_labels"), F.concat_ws(",", c["labels"]).alias("labels"), c["score"].alias("score"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, n) for n in ("documents", "labels"))
    held_out = langid.fold("doc_id", 4) == 2
    model = rules.train(docs, labels.where(~held_out), label="quality")
    return rules.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model, at=0.7).drop("text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(table(spark, sf_dir, "documents").select("doc_id", "text"), width=35)
    return out.select("doc_id", F.col("dedup.n_units").alias("n_words"), "dedup.n_removed", F.sha2("dedup.kept", 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_prefix_sum_shards,
        op2_weighted_mix,
        op3_minhash_near_dedup,
        op4_quality_rules,
        op5_decontamination,
        op6_suffix_array_dedup,
        op7_language_id,
        op8_licence_scan,
        op9_quality_classifier,
        op10_substring_dedup,
    )
}
ORACLE_SQL: dict[str, str] = {**WHOLE_SQL, "op4_quality_rules": QUALITY_SQL}
