"""Readers of the engine's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder; columns and filters push down."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
