"""Registered queries of the text operators: production parameters over whole tables."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import (
    bag_minhash,
    benchmark_decontamination,
    chat_formatting,
    importance_resampling,
    language_id,
    pii_surrogates,
    pitman_yor,
    quality_classifier,
    quality_rules,
    sequence_packing,
    substring_dedup,
    token_counts,
    vector_codes,
)
from tapeloom.llm.common import table

MAX_TOKENS = 2048
TOKEN_LIMIT = 4096
WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"
#: A run over private data passes a key of its own.
SURROGATE_KEY = "example key"


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_TOKENIZER)
    return sequence_packing.packed_digest(table(spark, sf_dir, "documents"), path, MAX_TOKENS)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.anonymised(docs, SURROGATE_KEY)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # A literal relation, so that no Python worker is started for the two rows.
    added = spark.sql(
        "SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS added(turn, role)"
    )
    return chat_formatting.digest(conversations.unionByName(added))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path(PIECE_MODEL)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), model, TOKEN_LIMIT)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.without_duplicates(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return importance_resampling.resampling(docs, target, percent=10).select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings")).drop("label")


def op13_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        op1_best_fit_packing,
        op2_language_id,
        op3_pii_surrogates,
        op4_minhash_near_dedup,
        op5_quality_rules,
        op6_chat_formatting,
        op7_quality_classifier,
        op8_token_counts,
        op9_substring_dedup,
        op10_benchmark_decontamination,
        op11_importance_resampling,
        op12_vector_codes,
        op13_pitman_yor_scores,
    )
}
ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": bag_minhash.oracle(),
    "op6_chat_formatting": chat_formatting.oracle(),
    "op9_substring_dedup": substring_dedup.oracle(),
    "op11_importance_resampling": importance_resampling.oracle(),
    "op12_vector_codes": vector_codes.oracle(),
}
