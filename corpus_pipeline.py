"""Training-corpus pipeline: five stages over `documents`, each working on all that the stage before it kept.

Toxic documents go; of each group of near copies one stays; documents that hold benchmark passages go; sources are mixed
to their target weights (documents repeat or drop out as the mix takes them); the rest is written as token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from voicetally.llm import decontamination, jaccard_join, mixing, token_store, toxicity
from voicetally.llm._io import materialize
from voicetally.llm.queries import fold, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"), fold(5, 0))


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_rows(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path, _ = token_store.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), hold=False)
    return token_store.read_store(docs, path)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("token_output", token_stage),
]

#: The grammar's learned weights and the tokenizer have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = materialize(docs, f"pipeline-{name}")
    return docs
