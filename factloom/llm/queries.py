"""The corpus operators as queries over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import chat, decontamination, mixing, passages, pii, quality, secrets, sharding, simhash, tokens
from factloom.llm.oracle import SQL

#: A public vocabulary; any sentencepiece model file will do.
MODEL_PATH = os.environ.get("FACTLOOM_TOKENIZER", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "cut")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(chat.with_control_conversation(_table(spark, sf_dir, "conversations")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), MODEL_PATH)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_numbers(_table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_mix": op2_mix,
        "op3_quality": op3_quality,
        "op4_simhash": op4_simhash,
        "op5_secrets": op5_secrets,
        "op6_chat": op6_chat,
        "op7_decontaminate": op7_decontaminate,
        "op8_tokens": op8_tokens,
        "op9_shard": op9_shard,
        "op10_passages": op10_passages,
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
