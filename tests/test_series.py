"""Blocked recurrences against one pass, and picks by rank against a sort."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import packing, recurrences, selection


def one_pass(rows, step, state, out=lambda s: s):
    found, last = {}, object()
    for run, at, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if run != last:
            last, s, n = run, state, 0
        s, n = step(s, x), n + 1
        found[run, n] = out(s)
    return found


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [(run, i, rng.uniform(-5, 40)) for run, n in ((1, 3000), (2, 1), (-7, 130), (None, 65)) for i in range(n)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "run long, at long, value double").repartition(3).cache()


def collected(df):
    got = df.collect()
    assert len({(r["run"], r["step"]) for r in got}) == len(got)
    return {(r["run"], r["step"]): r["out"] for r in got}


@pytest.mark.parametrize("size", [1, 64, 1 << 15])
def test_linear(table, rows, size):
    if size == 1:
        table, rows = table.filter("run <=> null OR run = 2"), [r for r in rows if r[0] in (None, 2)]
    want = one_pass(rows, lambda m, x: x if m is None else 0.75 * m + 0.25 * x, None)
    assert collected(recurrences.ema(table, ["at"], 0.25, size)) == pytest.approx(want)
    want = one_pass(rows, lambda u, x: 0.99 * u + 0.01 * x, 0.0)
    assert collected(recurrences.leaky(table, ["at"], 0.01, size)) == pytest.approx(want)


@pytest.mark.parametrize("leak, threshold, size", [(0.2, 60.0, 64), (0.0, 500.0, 50), (0.01, 1e9, 700), (0.5, -100.0, 1000)])
def test_spikes_are_those_of_one_pass(table, rows, leak, threshold, size):
    """Also without any spike or leak, where each block needs its predecessor's state."""
    want = one_pass(rows, lambda v, x: (0.0 if v >= threshold else v) * (1 - leak) + x, 0.0 if threshold > 0 else threshold - 1, lambda v: v >= threshold)
    if threshold < 0:
        want = dict.fromkeys(want, True)
    assert collected(recurrences.spikes(table, ["at"], leak, threshold, size)) == want


def test_a_long_series_is_shared_out(spark):
    """Blocks of one series lie in several tasks."""
    long = spark.range(400_000).select(F.lit(1).alias("run"), F.col("id").alias("at"), (F.col("id") % 97).cast("double").alias("value"))
    blocks = recurrences._blocks(long, ["at"], 1 << 15)
    per_task = [r["n"] for r in blocks.groupBy(F.shiftright("id", 33)).agg(F.sum("n").alias("n")).collect()]
    assert len(per_task) > 1 and max(per_task) < 300_000 and sum(per_task) == 400_000


def test_kth(spark):
    rng = random.Random(5)
    for data in ([rng.randrange(1 << 60) for _ in range(3000)], [rng.randrange(3) for _ in range(20_000)], [7] * 9000 + [(1 << 63) - 1, 0], [1 << 40] * 5000 + [(1 << 40) + 1] * 5000):
        df = spark.createDataFrame([(x,) for x in data] + [(None,)], "x long")
        for k in (1, 2, len(data) // 2, len(data)):
            want = sorted(data)[k - 1]
            assert selection.kth(df, k) == (want, sum(x < want for x in data), k)
        assert selection.kth(df, len(data) + 1) is None and selection.kth(df, 0) is None


def test_split(spark):
    def order(x):
        return int(hashlib.md5(f"9:{'' if x is None else x}".encode()).hexdigest()[:15], 16)

    for ids in (list(range(500)), [None, 3, 4], []):
        df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
        for share in (0, 0.1, 0.95, 1):
            want = set(sorted(ids, key=order)[: int(len(ids) * share)])
            assert {r["doc_id"] for r in packing.split(df, share, 9).filter("train").collect()} == want
    again = spark.createDataFrame([(i % 7,) for i in range(700)], "doc_id long")
    picked = packing.split(again, 0.5, 9).groupBy("doc_id").agg(F.count_distinct("train").alias("n"), F.max("train").alias("t")).collect()
    assert all(r["n"] == 1 for r in picked) and sum(r["t"] for r in picked) == 4  # 350 rows of 100 a key


def test_split_sorts_nothing_whole(spark):
    df = packing.split(spark.range(1000).withColumnRenamed("id", "doc_id"), 0.95, 1)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Exchange" not in plan and "Sort" not in plan
