"""Queries of section 2.G: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.plans.registry import query
from loomtext.sources.tables import table


@query(
    "G2_rollup",
    """
    WITH w AS (SELECT lang, source, len(regexp_extract_all(regexp_replace(text, ' +', ' ', 'g'), '\\S+')) AS n FROM documents),
    r AS (SELECT lang, source, CAST(sum(n) AS BIGINT) AS words, CAST(count(*) AS BIGINT) AS works FROM w GROUP BY ROLLUP (lang, source))
    SELECT r.lang, r.source, r.words, r.works, round(100.0 * r.words / t.words, 6) AS pct_total, round(100.0 * r.words / p.words, 6) AS pct_parent
    FROM r, (SELECT words FROM r WHERE lang IS NULL AND source IS NULL) t,
    (SELECT lang, words FROM r WHERE lang IS NOT NULL AND source IS NULL) p WHERE p.lang = r.lang AND r.source IS NOT NULL AND r.words > 0
    """,
)
def rollup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("lang", "source", T.word_count(T.collapse_spaces(F.col("text"))).alias("n"))
    low = docs.groupBy("lang", "source").agg(F.sum("n").alias("words"), F.count("*").alias("works"))
    top = low.groupBy("lang").agg(F.sum("words").alias("parent"))
    total = top.agg(F.sum("parent").alias("total"))
    out = low.filter("words > 0").join(top, "lang").join(F.broadcast(total))
    pct = lambda of: F.round(100.0 * F.col("words") / F.col(of), 6)
    return out.select("lang", "source", "words", "works", pct("total").alias("pct_total"), pct("parent").alias("pct_parent"))
