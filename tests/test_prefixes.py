"""Longest prefix joins against every rule tried on every text."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import prefixes


def test_longest(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("ab/é", k=rng.randrange(n)))
    texts = [(i, rng.choice(["x", "y", "z", None]), word(9) if i % 20 else None) for i in range(400)] + [(7, "x", "ab/")] * 2
    rules = [(rng.choice(["x", "y", None]), word(5) if i % 15 else None, rng.randrange(3), f"v{i}") for i in range(60)]
    got = prefixes.longest(spark.createDataFrame(texts, "id long, host string, path string"), spark.createDataFrame(rules, "host string, rule string, w int, v string"), "host", "path", "rule", F.struct("w", "v"), "v")

    def best(host, path):
        fits = [(len(p), w, v) for h, p, w, v in rules if None not in (h, p, host, path) and h == host and path.startswith(p)]
        return max(fits)[2] if fits else None

    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((i, h, p, best(h, p))) for i, h, p in texts)


@pytest.mark.parametrize("rules", [[], [("x", "", 1, "all")]])
def test_no_rules_and_empty_prefix(spark, rules):
    texts = spark.createDataFrame([("x", "/a"), ("y", "/b")], "host string, path string")
    got = prefixes.longest(texts, spark.createDataFrame(rules, "host string, rule string, w int, v string"), "host", "path", "rule", F.col("w"), "v")
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted([repr(("x", "/a", "all" if rules else None)), repr(("y", "/b", None))])


def test_no_nested_loop(spark):
    df = spark.range(10).selectExpr("cast(id as string) AS host", "'/a' AS path")
    plan = prefixes.longest(df, df, "host", "path", "path", F.lit(1), "host")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
