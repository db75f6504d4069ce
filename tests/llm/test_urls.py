"""The URL filter against plain rules and a plain model; accuracy on labels it hasn't seen."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loomtext.llm import urls
from tests.llm.test_against_brute_force import lower, same

ODD = [
    (1, None),
    (2, ""),
    (3, "no scheme at all/en/"),
    (4, "http://COM"),
    (5, "http://com/"),
    (6, "https://WWW.Example.COM/en/x?y=/z"),
    (7, "https://m.example.com/en/x#a://b"),
    (8, "https://notexample.com/en/"),
    (9, "https://example.com/EN/"),
    (10, "ftp://a.net/fr/"),
    (11, "ftp://a.net/fr"),
    (12, "x://net?/es/"),
    (13, "x://net#/es/"),
    (14, "a://b://net/es/"),
    (15, "://net/es/é😀"),
    (16, "http://host.org/" + "very/long/" * 40000),
    (17, "http://host.org/two\nlines"),
    (17, "http://host.org/two\nlines"),
    (None, "http://www.a.com:80/é"),
]


def split(url):
    if url is None or "://" not in url:
        return "", "", url or ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return lower(host), path, lower(host) + rest[len(host) :]


def ruled(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return (None, None) if best is None else (best.host + best.path, best.verdict)


class Plain:
    """The model by its definition, with dictionaries."""

    def __init__(self, texts, order, least):
        self.n, self.order, self.least = defaultdict(Counter), order, least
        for t in texts:
            s = [-1, *t.encode(), -2]
            for i in range(1, len(s)):
                for k in range(min(order, i) + 1):
                    self.n[tuple(s[i - k : i])][s[i]] += 1

    def p(self, ctx, c):
        lower = 1 / 256 if not ctx else self.p(ctx[1:], c)
        own = self.n.get(ctx)
        if not own or (ctx and sum(own.values()) < self.least):
            return lower
        return (own[c] + len(own) * lower) / (sum(own.values()) + len(own))

    def log(self, t):
        s = [-1, *t.encode(), -2]
        return sum(math.log(self.p(tuple(s[max(0, i - self.order) : i]), s[i])) for i in range(1, len(s)))


def test_parts_and_rules(spark, sf):
    data = ODD + [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    df = spark.createDataFrame(data, "page_id long, url string")
    host, path, text = urls.parts(F.col("url"))
    rule = urls.longest_rule(host, path)
    want = [(i, *split(u), *ruled(*split(u)[:2])) for i, u in data]
    same(df.select("page_id", host, path, text, rule["name"], rule["verdict"]), want)
    assert len({w[4] for w in want}) == 6


@pytest.mark.parametrize("order, least", [(0, 2), (2, 1), (5, 2)])
def test_model(spark, order, least):
    """All distinct labelled URLs fit in the sample: four fifths teach, the others calibrate."""
    texts = [(urls.ALLOW, f"a{i % 7}.com/de/{i}") for i in range(120)] + [(urls.BLOCK, f"b{i % 5}.net/fr/{i * i}.html") for i in range(150)] + [(urls.BLOCK, "é" * 50)]
    df = spark.createDataFrame(texts * 2, "verdict string, text string")
    made = urls.fit(df, order=order, least=least)
    held = {r[0] for r in df.filter(F.pmod(F.xxhash64("text", F.lit(2)), F.lit(urls.HELD_OUT)) == 0).select("text").distinct().collect()}
    assert 20 < len(held) < 100
    models = [Plain([t for v, t in texts if v == kind and t not in held], order, least) for kind in (urls.ALLOW, urls.BLOCK)]
    asked = ["", "a1.com/de/5", "b2.net/fr/49.html", "zzz", "é" * 60, "a3.com/fr/" + "x" * 3000]
    got = {r["text"]: r["score"] for r in urls.scored(spark.createDataFrame([(t, t) for t in asked], "asked string, text string"), made).collect()}
    for t in asked:
        assert got[t] == pytest.approx((models[0].log(t) - models[1].log(t)) / (len(t.encode()) + 1), abs=1e-9), t
    scores = {v: [(models[0].log(t) - models[1].log(t)) / (len(t.encode()) + 1) for k, t in texts if k == v and t in held] for v in (urls.ALLOW, urls.BLOCK)}
    right = lambda x: sum(s >= x for s in scores[urls.ALLOW]) / len(scores[urls.ALLOW]) + sum(s < x for s in scores[urls.BLOCK]) / len(scores[urls.BLOCK])
    best = max(right(x / urls.STEPS) for x in range(-urls.STEPS * 4, urls.STEPS * 4))
    assert right(made.threshold) == pytest.approx(best, abs=1e-9)


def test_blocks_of_long_urls(spark, monkeypatch):
    """A URL that spans blocks of positions scores as in one."""
    import numpy as np

    model = spark.createDataFrame([(urls.ALLOW, "abcabcabc"), (urls.BLOCK, "cbacba")] * 9, "verdict string, text string")
    made = urls.fit(model.union(spark.createDataFrame([(v, f"{'abc' if v == 'allow' else 'cba'}{i}") for v in ("allow", "block") for i in range(40)], "verdict string, text string")))
    data = np.frombuffer(b"abcabc" * 500 + b"cba" * 300 + b"x", np.uint8)
    off = np.array([0, 3000, 3000, 3900, 3901])
    whole = urls.ratios(made.models, off, data, made.order)
    monkeypatch.setattr(urls, "BLOCK_SIZE", 7)
    np.testing.assert_allclose(urls.ratios(made.models, off, data, made.order), whole, atol=1e-12)
    assert whole[0] > 0 > whole[2]


def test_query(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = spark.createDataFrame([(*r, None, "x", 1) for r in ODD], "page_id long, url string, html string, rule string, score int")
    pages.withColumn("rule", F.lit("x")).withColumn("score", F.lit(1)).unionByName(odd).write.parquet(f"{tmp_path}/pages.parquet")
    got = urls.op13_url_filter(spark, str(tmp_path)).collect()
    data = [tuple(r) for r in pages.select("page_id", "url").collect()] + ODD
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"]) for r in got) == Counter((i, h, p, ruled(h, p)[0]) for i, u in data for h, p, _ in [split(u)])
    for r in got:
        told = ruled(r["host"], r["path"])[1]
        assert r["verdict"] == (told or ("allow" if r["score"] >= r["threshold"] else "block"))
        assert math.isfinite(r["score"])
    assert {r["verdict"] for r in got if r["rule"] is None} == {"allow", "block"}


def test_accuracy_on_unseen_labels(spark):
    """Rules decide the tables' URLs; models taught by one half tell the other half."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path, text = urls.parts(F.col("url"))
    rows = pages.select(urls.longest_rule(host, path)["verdict"].alias("verdict"), text.alias("text"), F.col("page_id")).filter("verdict IS NOT NULL")
    made = urls.fit(rows.filter("page_id % 2 = 0").select("verdict", "text"))
    tried = urls.scored(rows.filter("page_id % 2 = 1").select("text", "verdict"), made).collect()
    by = lambda v: [(r["score"] >= made.threshold) == (v == urls.ALLOW) for r in tried if r["verdict"] == v]
    assert sum(by(urls.ALLOW)) / len(by(urls.ALLOW)) + sum(by(urls.BLOCK)) / len(by(urls.BLOCK)) > 1.7


def test_sample_is_bounded(spark):
    rows = spark.range(20000).selectExpr("if(id % 2 = 0, 'allow', 'block') AS verdict", "concat('h', id, if(id % 2 = 0, '.com/', '.net/'), repeat('x', 20)) AS text")
    small = urls.fit(rows, sample_bytes=1 << 14)
    whole = urls.fit(rows, sample_bytes=1 << 30)
    size = lambda m: sum(len(gram) for _, _, gram, _ in m.models[0].levels)
    assert size(small) < 12000 < size(whole)


def test_all_labelled_urls_teach(spark):
    """More than a sample of a megabyte a class would hold, and long ones."""
    rows = spark.range(80000).selectExpr("if(id % 2 = 0, 'allow', 'block') AS verdict", "concat(sha(string(id)), if(id % 2 = 0, '.com/', '.net/')) AS text")
    size = lambda m: [sum(len(gram) for _, _, gram, _ in x.levels) for x in m.models]
    assert size(urls.fit(rows)) == size(urls.fit(rows, sample_bytes=1 << 40))
    long = spark.range(40).selectExpr("if(id % 2 = 0, 'allow', 'block') AS verdict", "concat(id, repeat('abc', 1000)) AS text")
    assert min(size(urls.fit(long))) > 0


def test_no_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none).count() == 0
    only = urls.judge(spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")).collect()
    assert [(r["rule"], r["verdict"], r["score"]) for r in only] == [(None, "allow", 0.0)] * 2
