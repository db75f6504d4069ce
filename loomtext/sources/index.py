"""Index files: records cut by a delimiter out of files of any size, looked up by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARAGRAPH = "\n\n"


def records(spark: SparkSession, path: str, delimiter: str = PARAGRAPH) -> DataFrame:
    """(record, file, start, place): what stands between delimiters. A file is read in
    splits; a record belongs to the split it begins in, wherever it ends. ``start`` and
    ``place`` give the order of a file's records."""
    lines = spark.read.option("lineSep", delimiter).text(path)
    at = [F.col(f"_metadata.{c}").alias(n) for c, n in (("file_path", "file"), ("file_block_start", "start"))]
    return lines.select(F.col("value").alias("record"), *at, F.monotonically_increasing_id().alias("place"))


def entry(record: Column) -> Column:
    """struct<id, name> of a record, else null: its first line that isn't empty ends in
    three spaces and the id, with nothing but spaces before that in its last ten
    characters; the name has the title before three spaces, the id, and an extension by
    the language note. Records that start with a space carry on another's."""
    line = F.regexp_extract(record, r"^\n*([^\n]*)", 1)
    digits = F.regexp_extract(line, r" {3}([0-9]+)$", 1)
    found = (digits != "") & F.right(line, F.lit(10)).rlike("^ *[0-9]+$") & (F.length(digits) <= 10) & ~record.startswith(" ")
    foreign = F.contains(record, F.lit("[Language: ")) & ~F.contains(record, F.lit("English"))
    ext = F.when(foreign, F.lit(".IGNORE")).otherwise(F.lit(".txt"))
    name = F.concat(F.split_part(line, F.lit("   "), F.lit(1)), F.lit(" ("), digits, F.lit(")"), ext)
    return F.when(found, F.struct(digits.cast("long").alias("id"), name.alias("name")))


def entries(rows: DataFrame) -> DataFrame:
    """(id, name) of an index's records, each id once, as it comes first in the files."""
    own = rows.select(entry(F.col("record")).alias("e"), F.struct("file", "start", "place").alias("at")).filter("e IS NOT NULL")
    return own.groupBy(F.col("e.id").alias("id")).agg(F.min_by("e.name", "at").alias("name"))


def lookup(spark: SparkSession, path: str, wanted: DataFrame, key: str = "work_id") -> DataFrame:
    """(work_id, name) for every wanted id once; the name is null where the index has none."""
    ids = wanted.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct()
    return ids.join(entries(records(spark, path)), F.col(key) == F.col("id"), "left").select(key, "name")


def save(rows: DataFrame, path: str, delimiter: str = PARAGRAPH) -> None:
    """Write a column of records as index files, replacing what was there."""
    rows.write.mode("overwrite").option("lineSep", delimiter).text(path)
