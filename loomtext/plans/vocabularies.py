"""Queries that number a whole table, look words up in a vocabulary, or search many words."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import numbering, search
from loomtext.plans.registry import query
from loomtext.plans.relational import DIALECT
from loomtext.sources.tables import table

WORDS, NAMES = (DIALECT[k][1] for k in ("WORDS", "NAMES"))
_BENCH_WORDS = "SELECT unnest(string_split(text, ' ')) AS w FROM benchmark"
#: What a vocabulary starts with, in order; a mark that is listed twice has two ids.
SPECIALS = ("<PAD>", "<UNK>", "<SOS>", "<EOS>")
PUNCTUATION = (" ", ",", ".", "!", "?", '"', "'", "-", "+", "=", "*", "/", "%", "^", "\\", "\n", "\t", "`", "¬", "~", "`", "$", "£", "@", "#", "&", "(", ")", "[", "]", "{", "}", "<", ">", "|", ":", ";", "_")
RESERVED = (*SPECIALS, *PUNCTUATION, *"0123456789")


def words(spark, sf_dir, name="documents", key="doc_id"):
    return table(spark, sf_dir, name).select(key, F.posexplode(F.split("text", " ", -1)).alias("pos", "w"))


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ", -1)).alias("w"))


@query("F3_substring_counts", f"WITH a AS (SELECT DISTINCT w AS word FROM ({NAMES}) UNION SELECT 'tion' AS word UNION SELECT 'the' AS word), d AS MATERIALIZED (SELECT lower(text) AS t FROM documents) SELECT word, CAST(sum((length(t) - length(replace(t, word, ''))) / length(word)) AS BIGINT) AS matches FROM d CROSS JOIN a GROUP BY word")
def substring_counts(spark, sf_dir):
    asked = names(spark, sf_dir).select(F.col("w").alias("word")).union(spark.range(1).select(F.explode(F.array(F.lit("tion"), F.lit("the")))))
    return search.substring_counts(table(spark, sf_dir, "documents"), asked)


@query("F5_token_ids", f"WITH v AS (SELECT token, row_number() OVER (ORDER BY token) AS id FROM (SELECT w AS token FROM ({_BENCH_WORDS}) UNION SELECT w AS token FROM ({NAMES}))) SELECT x.doc_id, x.pos, coalesce(v.id, 0) AS id FROM ({WORDS}) x LEFT JOIN v ON v.token = x.w")
def token_ids(spark, sf_dir):
    """All words of all documents, looked up in a vocabulary that lacks many (id 0)."""
    known = words(spark, sf_dir, "benchmark", "item_id").select("w").union(names(spark, sf_dir)).distinct()
    known = numbering.numbered(known, ["w"])
    found = words(spark, sf_dir).join(known, "w", "left")
    return found.select("doc_id", "pos", F.coalesce("id", F.lit(0).cast("long")).alias("id"))


@query("F6_shared_windows", f"WITH own AS (SELECT DISTINCT doc_id, win FROM ({DIALECT['WINDOWS'][1]})) SELECT doc_id, holder, count(*) AS windows FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY win) AS holder FROM own) GROUP BY doc_id, holder")
def shared_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    return search.window_holders(docs).withColumnRenamed("ord", "doc_id")


_QUOTED = ", ".join("'" + t.replace("'", "''") + "'" for t in RESERVED)


@query("G6_vocab_ids", f"WITH r AS (SELECT unnest(range(1, {len(RESERVED) + 1})) AS id, unnest([{_QUOTED}]) AS token), f AS (SELECT w, count(*) AS n FROM ({WORDS}) WHERE w <> '' GROUP BY w) SELECT token, id FROM r UNION ALL SELECT w AS token, {len(RESERVED)} + row_number() OVER (ORDER BY n DESC, w) AS id FROM f WHERE w NOT IN (SELECT token FROM r)")
def vocab_ids(spark, sf_dir):
    counts = words(spark, sf_dir).filter(~F.col("w").isin("", *RESERVED)).groupBy("w").agg(F.count("*").alias("n"))
    rest = numbering.numbered(counts, [F.col("n").desc(), "w"], start=len(RESERVED) + 1).select(F.col("w").alias("token"), "id")
    first = spark.range(1).select(F.posexplode(F.array(*map(F.lit, RESERVED))).alias("pos", "token"))
    return first.select("token", (F.col("pos") + 1).cast("long").alias("id")).union(rest)


@query("G7_alphabet", f"SELECT c, row_number() OVER (ORDER BY c) AS id FROM ({DIALECT['CHARS'][1]})")
def alphabet(spark, sf_dir):
    chars = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "")).alias("c")).filter("c <> ''").distinct()
    return numbering.numbered(chars, ["c"])


@query("G9_token_frequency", f"WITH words AS ({WORDS}), v AS (SELECT w, row_number() OVER (ORDER BY w) AS id FROM (SELECT w FROM words UNION SELECT w FROM ({NAMES}))) SELECT v.id, count(x.w) AS n FROM v LEFT JOIN words x ON x.w = v.w GROUP BY v.id")
def token_frequency(spark, sf_dir):
    """Of every document's words, and zero for the names that no document has."""
    counts = words(spark, sf_dir).groupBy("w").agg(F.count("*").alias("n"))
    every = counts.union(names(spark, sf_dir).distinct().withColumn("n", F.lit(0).cast("long")))
    every = every.groupBy("w").agg(F.sum("n").alias("n"))
    return numbering.numbered(every, ["w"]).select("id", "n")


@query("H7_offsets", f"SELECT doc_id, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first, n FROM (SELECT doc_id, {DIALECT['COUNT_WORDS'][1]} AS n FROM documents)")
def offsets(spark, sf_dir):
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.size(F.split("text", " ", -1)).cast("long").alias("n"))
    return numbering.totals_before(sizes, ["doc_id"], "n", "first").select("doc_id", "first", "n")
