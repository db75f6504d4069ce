"""Window dedup by runs against every window, and BPE rounds against single merges."""

import random

import pytest
from pyspark.sql import functions as F

from loomtext.operators import bpe, dedup


def texts_of(rng, alphabet, n):
    """Texts that share passages, whole and in part, some of them repetitive."""
    passages = ["".join(rng.choices(alphabet, k=rng.choice([3, 30, 200]))) for _ in range(6)]
    out = [None, "", "a", "".join(rng.choices(alphabet, k=11)), alphabet[0] * 300]
    for _ in range(n):
        parts = [p[rng.choice([0, 0, 5]) :] if rng.random() < 0.7 else "".join(rng.choices(alphabet, k=rng.randrange(40))) for p in rng.choices(passages, k=rng.randrange(5))]
        out.append("".join(parts))
    whole = max(map(len, filter(None, out)))
    return out + out[5:9] + [t[5 : 5 + n] for t in out if t and len(t) == whole for n in (1, 4, 11, 12, 13, 99, 100, 101)]


@pytest.mark.parametrize("width, alphabet", [(1, "ab"), (4, "abc"), (12, "abcdefghé😀"), (100, "abcdefghijklmnopqrstuvwxyz ")])
def test_first_windows(spark, width, alphabet):
    rng = random.Random(width)
    rows = list(enumerate(texts_of(rng, alphabet, 40)))
    want, seen = set(), set()
    for i, t in rows:
        t = t or ""
        for p in range(max(1, len(t) - width + 1)):
            w = t[p : p + width]
            if w not in seen:
                seen.add(w)
                want.add((i, p))
    docs = spark.createDataFrame(rows, "ord long, text string").repartition(3)
    got = dedup.first_windows(docs, width).collect()
    every = [(r["ord"], r["start"] + k) for r in got for k in range(r["size"])]
    assert len(every) == len(set(every)) and set(every) == want
    stats = dedup.statistics(docs.filter("text IS NOT NULL"), "precise", width).first()
    assert (stats["seen"], stats["kept"]) == (sum(max(1, len(t) - width + 1) for _, t in rows if t is not None), len(seen))


def test_runs_are_few(spark, sf):
    """A row for some dozens of characters, where windows would be one each."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("ord"), "text")
    got = dedup.first_windows(docs).agg(F.sum("size").alias("windows"), F.count("*").alias("rows")).first()
    assert got["rows"] < got["windows"] / 12


@pytest.mark.parametrize("seed", range(3))
def test_rounds_take_the_driver_s_merges(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aabcde", k=rng.randrange(1, 9))) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(words, k=20))) for i in range(25)], "doc_id long, text string")
    plain = [tuple(r) for r in bpe.train(docs, 60).orderBy("rank").collect()]
    assert [tuple(r) for r in bpe.train(docs, 60, max_words=0).orderBy("rank").collect()] == plain and len(plain) > 30


def test_rounds_are_fewer_than_merges(spark, sf, monkeypatch):
    rounds = []
    best = bpe._Cluster.best
    monkeypatch.setattr(bpe._Cluster, "best", lambda self: rounds.append(best(self)) or rounds[-1])
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = [tuple(r) for r in bpe.train(docs, 330, max_words=0).orderBy("rank").collect()]
    assert got == [tuple(r) for r in bpe.train(docs, 330).orderBy("rank").collect()]
    assert len(got) > 200 and len(rounds) < len(got) / 3


@pytest.mark.parametrize("top, pieces, size", [(4096, 100_000, 45), (12, 40, 24)])
def test_rounds_foresee_merges(spark, monkeypatch, top, pieces, size):
    """Rounds take merges that build on one another, and the driver's, however few pairs and pieces they see."""
    rounds, best = [], bpe._Cluster.best
    monkeypatch.setattr(bpe._Cluster, "best", lambda self: rounds.append(best(self)) or rounds[-1])
    monkeypatch.setattr(bpe, "_TOP", top)
    monkeypatch.setattr(bpe, "_PIECES", pieces)
    monkeypatch.setattr(bpe, "_WAITING", 20)
    rng = random.Random(5)
    words = ["".join(rng.choices("aaabcd", k=rng.randrange(1, 12))) for _ in range(150)]
    docs = spark.createDataFrame([(None if i == 3 else i % 20, " ".join(rng.choices(words, k=40))) for i in range(25)], "doc_id long, text string")
    got = [tuple(r) for r in bpe.train(docs, size, max_words=0).orderBy("rank").collect()]
    assert got == [tuple(r) for r in bpe.train(docs, size, max_words=10**9).orderBy("rank").collect()]
    assert len(got) > size - 10 and (top < 4096 or len(rounds) < 5)


def test_independent():
    top = [(("a", "b"), 9), (("c", "d"), 8), (("b", "c"), 7), (("e", "f"), 7)]
    assert bpe.independent(top, True) == top[:2]
    assert bpe.independent([(("a", "b"), 9), (("c", "d"), 7), (("b", "e"), 7)], True) == [(("a", "b"), 9)]
    assert bpe.independent([(("a", "a"), 9), (("b", "c"), 8), (("d", "a"), 7)], True) == [(("a", "a"), 9), (("b", "c"), 8)]
    assert bpe.independent([(("a", "b"), 9), (("c", "d"), 8), (("e", "f"), 8)], False) == [(("a", "b"), 9)]
    assert bpe.independent([], True) == []
