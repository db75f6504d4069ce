"""Operator 10: exact dedup by a 128-bit content hash, bytes compared in groups.

Built-in functions only. Rows are grouped by the first 128 bits of the text's
SHA-256 and, inside that group, by the text itself: the hash table compares the
bytes, and copies collapse on the map side before anything moves. Two texts that
share the 128 bits come out as two groups; they are told apart afterwards by the
other 128 bits, and should those agree as well the query fails loudly rather
than merging them. Rows then get their group by a join on the digest; the join
spreads the hottest groups (``spread_join``).

Defined results: null text counts as empty; of rows that repeat the id that
stays, all are marked as kept (they are the same document); a group whose ids
are all null keeps its rows, with keep_id null; a null id beside others is
dropped; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import digest, materialise, spread_join, unused

ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       t.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""


def content_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 128) -> DataFrame:
    """(digest, keep_id, group_size), a row for each distinct text. ``key_bits``
    is the width of the grouping hash (tests narrow it to force collisions)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    docs = docs.withColumn("digest", F.unhex(F.sha2("text", 256)))
    docs = docs.withColumn("key", F.substring("digest", 1, key_bits // 8))
    same = docs.groupBy("key", "digest", "text").agg(F.count("*").alias("n"), F.max("id").alias("keep"))
    out = same.groupBy("digest").agg(F.sum("n").alias("group_size"), F.max("keep").alias("keep_id"), F.count("*").alias("texts"))
    size = F.when(F.col("texts") > 1, F.raise_error("two texts share a SHA-256 digest").cast("long")).otherwise(F.col("group_size"))
    return out.select("digest", "keep_id", size.alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 128) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), a row for each input row."""
    groups = materialise(content_groups(docs, id_col, text_col, key_bits), "content")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))
    out = spread_join(rows, groups, "digest", "group_size", F.xxhash64("doc_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, the one with the largest id; of
    rows that repeat id and text, the first by a hash of all their columns, whose types
    need no order."""
    names = docs.columns
    own, id_, digest_ = unused(docs, "own", "id", "digest")
    drop = exact_groups(docs, id_col, text_col).filter("not kept")
    drop = drop.select(F.col("doc_id").alias(id_), F.unhex("text_sha256").alias(digest_)).distinct()
    rows = docs.withColumn(own, digest(F.col(text_col).cast("string")))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(digest_) == F.col(own))
    rows = rows.join(drop, same, "left_anti")
    again = rows.groupBy(F.col(id_col).alias(id_), F.col(own).alias(digest_)).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = materialise(again, "again")
    if again.isEmpty():
        return rows.drop(own)
    every = F.struct(*[F.col(f"`{c}`") for c in names])
    first = rows.join(again, same, "left_semi").select(F.col(id_col).alias("id"), F.col(own).alias("own"), every.alias("row"), F.sha2(F.to_json(every), 256).alias("rank"))
    first = first.groupBy("id", "own").agg(F.min_by("row", "rank").alias("row"))
    return rows.join(again, same, "left_anti").select(*[f"`{c}`" for c in names]).union(first.select(*[F.col("row").getField(c).alias(c) for c in names]))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
