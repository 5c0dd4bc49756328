"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, language_model, licenses, packing, quality_classifier, quality_rules, sharding, simhash, sql, substring_dedup
from .storage import table


def op1_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_report(table(spark, sf_dir, "documents"))


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op5_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_report(rows.union(chat.sample(spark)))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.model_report(table(spark, sf_dir, "documents"))


def op7_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(table(spark, sf_dir, "documents"))


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.classified(docs, quality_classifier.fitted(docs, table(spark, sf_dir, "labels")))


def op10_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_paragraph_minhash, op2_vector_packing, op3_adaptive_quality, op4_virtual_slots, op5_relational_chat, op6_log_bilinear,
        op7_license_digest, op8_simhash_trie, op9_factorisation_machine, op10_spaced_seeds,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express; the others are tested against plain Python."""
    return sql.oracle_sql()
