"""Queries of C12, C13, D6, B2 and of the streaming extension's batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import repair
from loomtext.functions import text as T
from loomtext.operators import lines, numbering, recurrences
from loomtext.plans.corpus import joined_sql
from loomtext.plans.registry import query
from loomtext.plans.strings import policy_sql
from loomtext.sources import corpus
from loomtext.sources.tables import table
from loomtext.streaming import monitor


@query("C12_fix_text")
def fix_text(spark, sf_dir):
    return repair.mapped(table(spark, sf_dir, "documents"), repair.fix)


_PASSAGE = r"'\n*.{55,}\n\n.{40,}\n'"


def _unwrapped(texts: str) -> str:
    lengths = policy_sql(T.NEWLINE_POLICIES["C6"], "h[i]")
    return f"SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(h) THEN {lengths} ELSE '' END), '') AS text FROM (SELECT doc_id, string_split_regex(t, {_PASSAGE}) AS g, regexp_extract_all(t, {_PASSAGE}) AS h FROM ({texts}))"


@query("C13_unwrap", _unwrapped("SELECT doc_id, replace(text, chr(10), repeat(chr(10), 2)) AS t FROM documents"))
def unwrap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return docs.select("doc_id", T.unwrap(F.col("text")).alias("text"))


_TIDY = "replace(replace(regexp_replace(text, ' +', ' ', 'g'), chr(9) || ' ', chr(9)), ' ' || chr(9), chr(9))"


@query("D6_clean", joined_sql(f"SELECT doc_id, {_TIDY} AS text FROM ({_unwrapped('SELECT doc_id, text AS t FROM documents')})"))
def clean(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lines.joined(docs.select("doc_id", T.tidy_tabs(T.collapse_spaces(T.unwrap(F.col("text")))).alias("text")))


@query("B2_rename", r"SELECT doc_id, regexp_replace(source || '_' || doc_id || '.x.txt', '^(.*)_([^_.]*)\..*?([^.]*)$', '\1 (\2).\3') AS name FROM documents")
def rename(spark, sf_dir):
    name = F.concat("source", F.lit("_"), "doc_id", F.lit(".x.txt"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.renamed(name).alias("name"))


@query("B3_mirror", "SELECT doc_id, '/to/' || source || '/' || doc_id || '.TRA' AS path FROM documents")
def mirror(spark, sf_dir):
    path = F.concat(F.lit("/from/"), "source", F.lit("/"), "doc_id", F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.mirrored(path, "/from", "/to", ".TRA").alias("path"))


@query("B4_numbered_words", "SELECT row_number() OVER (ORDER BY c_name) AS word_id, c_name AS word FROM customer")
def numbered(spark, sf_dir):
    return numbering.numbered(table(spark, sf_dir, "customer").select(F.col("c_name").alias("word")), ["word"], "word_id")


@query("M_metric_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS least FROM events GROUP BY 1, 2")
def metric_windows(spark, sf_dir):
    out = monitor.metric_windows(table(spark, sf_dir, "events"))
    return out.withColumn("mean", F.round("mean", 6)).withColumn("start", F.col("start").cast("timestamp_ntz"))


def _fit_sql(degree: int) -> str:
    """The normal equations, eliminated column by column; a row holds the system."""
    n, names = degree + 1, lambda i, j: f"m{i}_{j}"
    cells = [f"sum(pow(x, {i + j})) AS {names(i, j)}" for i in range(n) for j in range(n)]
    cells += [f"sum(pow(x, {i}) * y) AS {names(i, n)}" for i in range(n)]
    ctes = ["p AS (SELECT event_id / 10000.0 AS x, value AS y FROM events)", f"s0 AS (SELECT {', '.join(cells)} FROM p)"]
    for k in range(n):
        new = [f"{names(i, j)}{'' if i == k else f' - {names(i, k)} / {names(k, k)} * {names(k, j)}'} AS {names(i, j)}" for i in range(n) for j in range(n + 1)]
        ctes.append(f"s{k + 1} AS (SELECT {', '.join(new)} FROM s{k})")
    rows = " UNION ALL ".join(f"SELECT {i} AS power, round({names(i, n)} / {names(i, i)}, 4) AS coefficient FROM s{n}" for i in range(n))
    return f"WITH {', '.join(ctes)} {rows}"


@query("H14_cubic_fit", _fit_sql(3))
def cubic_fit(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select((F.col("event_id") / 10000).alias("x"), F.col("value").alias("y"))
    rounded = F.signum("coefficient") * F.round(F.abs("coefficient"), 4)  # a zero keeps its sign, as in SQL
    return recurrences.polynomial_fit(ev, "x", "y", 3).withColumn("coefficient", rounded)
