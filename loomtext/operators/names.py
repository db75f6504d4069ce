"""Name lists as labelled pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(rows: DataFrame) -> DataFrame:
    """(category, line_no, ask, answer) of (category, line_no, name): the words of each
    name, first and last of three or four words without a parenthesis, and the name;
    each once a category, where it comes first."""
    t = F.split("name", " ")
    ends = F.when(F.size(t).isin(3, 4) & ~F.contains("name", F.lit("(")), F.array(F.concat(t[0], F.lit(" "), F.element_at(t, -1))))
    every = F.concat(t, F.coalesce(ends, F.array().cast("array<string>")), F.array("name"))
    one = rows.select("category", "line_no", F.posexplode(every).alias("pos", "token"))
    one = one.groupBy("category", "token").agg(F.min(F.struct("line_no", "pos"))["line_no"].alias("line_no"))
    mark = lambda a, b: F.concat(F.lit("<BOS>"), a, F.lit("<RESP>"), b, F.lit("<EOS>"))
    return one.select("category", "line_no", mark(F.col("category"), F.col("token")).alias("ask"), mark(F.col("token"), F.col("category")).alias("answer"))


def fold(rows: DataFrame, least: int = 2500, misc: str = "<folder-Misc>") -> DataFrame:
    """(category, class, n, held_out): categories of under ``least`` lines share one class. A
    category's first line empties what its class holds out, so that of those that share
    one only the last category's examples are held out (K14)."""
    n = rows.groupBy("category").agg(F.count("*").alias("n"))
    small = F.col("n") < least
    last = n.agg(F.max(F.when(small, F.col("category"))).alias("last"))
    name = F.when(small, F.lit(misc)).otherwise(F.concat(F.lit("<"), "category", F.lit(">")))
    kept = ~small | F.col("category").eqNullSafe(F.col("last"))
    return n.crossJoin(F.broadcast(last)).select("category", name.alias("class"), "n", kept.alias("held_out"))
