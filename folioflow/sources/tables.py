"""Parquet table reader of a corpus directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, corpus_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a corpus directory. Column pruning and filters reach the scan."""
    return spark.read.parquet(f"{corpus_dir}/{name}.parquet")
