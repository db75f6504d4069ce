"""Longest prefix joins: rules with a key and a prefix, texts that start with it.

Rules are cut to (key, length, hash of the prefix). A text is asked for its prefixes
of the lengths that rules of its key have, by an equi-join, and of those that a rule
has the longest wins: no text meets a rule that it doesn't start with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest(texts: DataFrame, rules: DataFrame, key: str, text: str, prefix: str, wins: Column, value: str) -> DataFrame:
    """``texts`` with ``value`` of the longest ``prefix`` of a rule with the same ``key`` that
    ``text`` starts with, null if there is none; of rules with one prefix the greatest by
    ``wins``. An empty prefix fits any text; rules without a prefix fit none. Every row
    comes out once."""
    own = rules.select(F.col(key).alias("k"), F.col(prefix).alias("p"), wins.alias("w"), F.col(value).alias("v")).filter("k IS NOT NULL AND p IS NOT NULL")
    best = own.groupBy("k", "p").agg(F.max_by("v", "w").alias("v")).withColumn("n", F.length("p"))
    lengths = best.groupBy("k").agg(F.sort_array(F.collect_set("n"), asc=False).alias("lengths"))
    names = texts.columns
    rows = texts.select(F.struct(*names).alias("row"), F.col(key).alias("k"), F.col(text).alias("t"), F.monotonically_increasing_id().alias("id"))
    asked = rows.join(lengths, "k", "left")
    one = F.transform(F.filter(F.coalesce("lengths", F.array().cast("array<int>")), lambda n: n <= F.length("t")), lambda n: F.struct(n.alias("n"), F.xxhash64("k", F.substring("t", F.lit(1), n)).alias("h")))
    asked = asked.select("row", "k", "t", "id", F.explode_outer(one).alias("a")).select("row", "k", "t", "id", "a.n", "a.h")
    hashed = best.select("k", "p", "n", "v", F.xxhash64("k", "p").alias("h"))
    met = asked.join(hashed, ["k", "n", "h"], "left")
    fits = F.col("p").isNotNull() & F.startswith("t", "p")
    found = met.groupBy("id").agg(F.any_value("row").alias("row"), F.max_by(F.when(fits, F.struct("v")), F.when(fits, F.col("n"))).alias("f"))
    return found.select("row.*", F.col("f.v").alias(value))
