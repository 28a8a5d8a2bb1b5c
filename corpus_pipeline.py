"""A training-data pipeline: filter by quality, drop near duplicates, drop benchmark leaks, mix sources, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, quality, sharding, simhash
from lodestone.llm.common import materialise, read

#: Score below which the classifier rejects a document; shards of the last stage.
LEAST_QUALITY, SHARDS = 0.7, 24


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (trained on labelled documents of docs) doesn't reject."""
    net = quality.train_on(docs, read(spark, sf_dir, "labels"))
    return quality.with_score(docs, net, "__score").where(F.col("__score") >= LEAST_QUALITY).drop("__score")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_documents(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, of near equal bytes."""
    return sharding.with_shard(docs, SHARDS)


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("mixing sources", mixed_sources),
    ("sharding", sharded),
]

#: SQL can't express the trained classifier, nor the fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
