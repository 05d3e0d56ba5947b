"""Corpus pipeline: language ID, near-dedup, decontamination, personal data, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, all but the last with the columns of ``documents``:

1. language_id keeps the documents whose language is not rejected;
2. near_dedup keeps one document of each near-duplicate class;
3. decontamination drops documents that hold a benchmark item;
4. pii replaces personal data in the texts by surrogates;
5. packing gives the pieces of all documents their places in sequences.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import bag_minhash, benchmark_decontamination, language_id, pii_surrogates, sequence_packing
from tapeloom.llm.common import table
from tapeloom.llm.queries import MAX_TOKENS, SURROGATE_KEY, WORD_TOKENIZER
from tapeloom.session import checkpoint_root


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.kept(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bag_minhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return benchmark_decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii_surrogates.anonymised(docs, SURROGATE_KEY)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sequence_packing.packed_digest(docs, public_tokenizers.path(WORD_TOKENIZER), MAX_TOKENS)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("packing", pack_sequences),
]

#: Classification by compression, edit distances and keyed hashes have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over ``documents``; stages in between are written and read again."""
    folder = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
