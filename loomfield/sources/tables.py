"""Loaders of the input tables and the adapter views that operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as corpus records: doc_id, text, modality (every language has natural thresholds), family."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lit("text").alias("modality"), F.col("lang"), F.col("source").alias("family"))
