"""Datasets, caches and metrics as Parquet and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_dataset(rows: DataFrame, folder: str) -> None:
    """Texts (idx, text, n, marker) with a folder for each marker, replacing what was there
    (A12): whoever wants one bucket reads that folder only."""
    rows.select("idx", "text", "n", "marker").write.mode("overwrite").partitionBy("marker").parquet(folder)


def load_dataset(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("idx long, text string, n long, marker int").parquet(folder)


def save_tokens(docs: DataFrame, folder: str) -> None:
    """Token ids of (doc_id, ids) and their number, replacing what was there."""
    docs.select("doc_id", F.col("ids").cast("array<int>").alias("ids"), F.size("ids").alias("length")).write.mode("overwrite").parquet(folder)


def load_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids, length) as saved."""
    return spark.read.schema("doc_id long, ids array<int>, length int").parquet(folder)


def append_metrics(rows: DataFrame, folder: str) -> None:
    """Rows (run, kind, step, value) beside those of earlier calls, by kind."""
    rows.select("run", "kind", "step", "value").write.mode("append").partitionBy("kind").parquet(folder)


def load_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("run long, step long, value double, kind string").parquet(folder)


def save_model(vocabulary: DataFrame, config: dict[str, str], folder: str) -> None:
    """A vocabulary as Parquet and its settings as JSON."""
    vocabulary.write.mode("overwrite").parquet(f"{folder}/vocabulary")
    spark = vocabulary.sparkSession
    spark.range(1).select(*[F.lit(v).alias(k) for k, v in config.items()]).write.mode("overwrite").json(f"{folder}/config")


def load_model(spark: SparkSession, folder: str, schema: str, config: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(schema).parquet(f"{folder}/vocabulary"), spark.read.schema(config).json(f"{folder}/config")


def save_frequencies(counts: DataFrame, folder: str) -> None:
    """(token, n) and, in each row, the vocabulary's size and all occurrences."""
    whole = counts.agg(F.count("*").alias("vocab_size"), F.sum("n").alias("total"))
    counts.crossJoin(F.broadcast(whole)).write.mode("overwrite").parquet(folder)
