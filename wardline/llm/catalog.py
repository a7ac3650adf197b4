"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wardline.llm.base import table

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.shards import shard_contents

    return shard_contents(table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.chat import digests, fixed_conversation, format_conversations

    return digests(format_conversations(fixed_conversation(table(spark, sf_dir, "conversations"))))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.urlfilter import page_verdicts

    return page_verdicts(table(spark, sf_dir, "pages"))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.bytebpe import round_trip_digests

    return round_trip_digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, public_tokenizers.PATTERN)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.capsearch import embedding_components

    return embedding_components(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.merkle import manifest

    return manifest(table(spark, sf_dir, "documents"))


def op12_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.topk import exact_search

    return exact_search(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.repair import repaired_conversations

    return repaired_conversations(table(spark, sf_dir, "conversations"))


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def sql_texts() -> dict[str, str]:
    from wardline.llm import capsearch, chat, merkle, quality, repair, simhash, topk, urlfilter

    return {
        "op3_simhash_near_dedup": simhash.SQL,
        "op5_chat_formatting": chat.SQL,
        "op7_url_filters": urlfilter.SQL,
        "op9_quality_rules": quality.SQL,
        "op10_embedding_near_dedup": capsearch.SQL,
        "op11_merkle_manifest": merkle.SQL,
        "op12_exact_top_k": topk.SQL,
        "op13_conversation_repair": repair.SQL,
    }
