"""Collects the queries of the library's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attended, batches, checks, containers, documents, domains, figured, fixtures, governed, ledgers, paged, records, resampled, stats, texts, tokens, vectors  # noqa: F401
from .base import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and documents by language and source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
