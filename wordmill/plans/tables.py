"""Driver tables and the roles they play for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordmill.sources.corpus import corpus_from_documents


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, title, text`` from ``documents`` (title = first line)."""
    return corpus_from_documents(table(spark, sf_dir, "documents"))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query`` from ``benchmark``."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").cast("long").alias("query_id"), F.col("text").alias("query"))
