"""The operators' queries over the standard tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontamination, filter_audit, jaccard_join, lang_id, lm_score, mixing, quality_rules, secret_scan, sql, substring_dedup, token_store, toxicity, vector_codes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    base = F.col("failed").bitwiseAND(F.lit(quality_rules.mask("v1"))) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))[0].select("doc_id", "n_shingles", "component_id")


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path, _ = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=600_000)
    return token_store.read_store(docs, path)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return chat_format.recover(spark, table(spark, sf_dir, "conversations"), held_out)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def fold(folds: int, k: int):
    """Whether crc32 of doc_id as text leaves k; rows without an id belong to no fold."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == k, F.lit(False))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5, 0))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"), fold(10, 0))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(table(spark, sf_dir, "documents"), fold(3, 1))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.quantize(table(spark, sf_dir, "embeddings"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality_rules": op2_quality_rules,
    "op3_mix": op3_mix,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_token_store": op5_token_store,
    "op6_chat_format": op6_chat_format,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_lm_score": op9_lm_score,
    "op10_lang_id": op10_lang_id,
    "op11_filter_audit": op11_filter_audit,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scan": op13_secret_scan,
}

ORACLE: dict[str, str] = {
    "op1_decontaminate": sql.DECONTAMINATION,
    "op2_quality_rules": quality_rules.SQL,
    "op4_jaccard_join": sql.JACCARD,
    "op7_substring_dedup": sql.SUBSTRINGS,
    "op11_filter_audit": filter_audit.SQL,
    "op12_vector_codes": vector_codes.SQL,
    "op13_secret_scan": secret_scan.SQL,
}
