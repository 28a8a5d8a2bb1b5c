"""The driver's tables, as the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import index_words
from lodestone.operators import chunking, retrieval


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows over all cores, where their scan has fewer tasks than that (a small file of one row group)."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def chunk_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(chunking.pages_of_documents(spread(table(spark, sf_dir, "documents"))))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as linked records: a turn is a record, a conversation a document."""
    from pyspark.sql import Window

    ident = F.concat(F.lit("c"), F.col("conv_id"), F.lit("t"), F.col("turn"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("chunk_id", ident)
    return rows.withColumns({"previous_chunk_id": F.lag("chunk_id").over(order), "next_chunk_id": F.lead("chunk_id").over(order)})


def query_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search phrases of each benchmark item."""
    return retrieval.query_words(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


def item_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole benchmark item as one phrase."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(0).alias("phrase_no"), index_words(F.col("text")).alias("words"))
    return items.where(F.size("words") > 0)


def query_vectors(spark: SparkSession, sf_dir: str, modulus: int = 50) -> DataFrame:
    """The stated query batch: embeddings whose id is divisible by 50."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % modulus == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
