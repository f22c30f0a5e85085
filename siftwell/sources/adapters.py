"""Record, prediction and history tables over the tables at hand.

A document stands for an image record: its length for the shorter side, its share of
distinct words for sharpness, a 64-bit SimHash for the perceptual hash. An embedding
stands for a prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.hashes import word_hashes

N_CLASSES = 7


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with n_words, n_distinct and phash of its text; documents without words have the hash of zeros."""
    return word_hashes(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"))


def records(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, min_side, blur, cls, cls7, subclass, raw_sig and sig_b of each document, and ``more`` of what is measured."""
    bucket = F.least(F.expr("n_chars DIV 1000"), F.lit(5)).cast("string")
    return measured(spark, sf_dir).select(
        "doc_id",
        F.col("n_chars").alias("min_side"),
        F.when(F.col("n_words") > 0, 100.0 * F.col("n_distinct") / F.col("n_words")).otherwise(F.lit(0.0)).alias("blur"),
        F.col("lang").alias("cls"),
        F.expr(f"CAST(substr(source, 4) AS INT) % {N_CLASSES}").alias("cls7"),
        F.col("source").alias("subclass"),
        F.concat_ws("_", "lang", "source", bucket).alias("raw_sig"),
        bucket.alias("sig_b"),
        *more,
    )


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and phash of each document."""
    return measured(spark, sf_dir).select("doc_id", "phash")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, prediction, conf, source and probs (array of seven) of each embedding."""
    z = F.transform(F.slice("embedding", 1, N_CLASSES), lambda x: 8.0 * x.cast("double"))
    e = read(spark, sf_dir, "embeddings").withColumn("e", F.transform(z, F.exp))
    e = e.withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    probs = e.withColumn("probs", F.transform("e", lambda x: F.round(x / F.col("t"), 6)))
    top = F.array_max("probs")
    return probs.select(
        F.col("vec_id").alias("id"),
        (F.col("label") % N_CLASSES).alias("label"),
        (F.array_position("probs", top) - 1).cast("int").alias("prediction"),
        top.alias("conf"),
        F.concat(F.lit("src"), (F.col("vec_id") % 5).cast("string")).alias("source"),
        "probs",
    )
