"""The ten operators and the pipeline as named queries, with DuckDB SQL where SQL can express the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, language_model, lines, mixing, oracles, quality, secrets, sharding, simhash, spotsigs, token_files
from lodestone.llm.common import read


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_fingerprints(read(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(read(spark, sf_dir, "documents"))


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(read(spark, sf_dir, "documents"), 24)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(read(spark, sf_dir, "documents"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = language_model.document_scores(read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("score", 6).alias("score"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_spotsigs, op2_decontaminate, op3_token_files, op4_secrets, op5_simhash, op6_shards, op7_line_dedup, op8_language_model, op9_quality, op10_mixing)
    return {f.__name__: f for f in ops} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
