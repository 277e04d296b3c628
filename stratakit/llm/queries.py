"""The corpus operators as queries over the driver's tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratakit.llm import language, licenses, mixing, quality, secrets, sentencepieces, sharding, substrings, vectors
from stratakit.llm.common import table
from stratakit.llm.simhash import simhash_components


def op1_sentencepiece_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.round_trip(table(spark, sf_dir, "documents"), sentencepieces.load(sentencepieces.model_of(spark)))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.without_repeats(table(spark, sf_dir, "documents"), window=13)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", "taken")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(table(spark, sf_dir, "documents"), licenses.Templates())
    names = F.array_sort(F.array_distinct(F.col("matches.license")))
    return found.select("doc_id", F.array_join(names, ",").alias("licenses"), F.array_max("matches.containment").alias("containment"))


def op5_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), bits=4, shingle=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs, held_out=2))
    held_out = F.coalesce(language.fold(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.embedding_components(table(spark, sf_dir, "embeddings"), least=0.98)
    return found.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece_coding": op1_sentencepiece_coding,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_license_scan": op4_license_scan,
    "op5_label_propagation_sharding": op5_label_propagation_sharding,
    "op6_simhash_dedup": op6_simhash_dedup,
    "op7_crf_quality": op7_crf_quality,
    "op8_language_id": op8_language_id,
    "op9_hnsw_dedup": op9_hnsw_dedup,
    "op10_secret_scan": op10_secret_scan,
}

SQL: dict[str, str] = {
    "op2_substring_dedup": substrings.SQL,
    "op3_source_mixing": mixing.SQL,
    "op4_license_scan": licenses.sql(),
    "op9_hnsw_dedup": vectors.SQL,
}
