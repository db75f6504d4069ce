"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_RUNS: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the folder set on the context; a local master without
    either takes one beside its warehouse."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and sc.master.startswith("local"):
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.loomtext"
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost
    executors, and goes when this application's driver ends."""
    path = scratch(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when this application's driver ends."""
    root = f"{shared_dir(spark)}/loomtext-scratch/{spark.sparkContext.applicationId}"
    if root not in _RUNS:
        _RUNS.add(root)
        atexit.register(_remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jvm is None or sc._jsc is None:
        return  # the session is over; its folder is left to the cluster's cleaning
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def small(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of so few rows that what a worker makes of one, as Python objects, stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
