"""Operator 13: URL filter by rules and, where none fits, by a ratio of character
language models.

Rules name a host, with its subdomains, and the start of a path; the longest that
fits decides. The URLs they decide teach two byte-level Markov models, one of
accepted and one of rejected URLs. Their order varies: a context counts if its class
has it MIN_SEEN times, and a byte is predicted from the longest that does, mixed
with the shorter ones by Witten-Bell weights down to a uniform distribution. Other
URLs are allowed if the difference of the two log-likelihoods, divided by the number
of predicted symbols, reaches a threshold; it's the one that told accepted from
rejected best on a fifth of the distinct labelled URLs, which the models haven't seen.

The models are fit on all other distinct labelled URLs, whole. Spark counts their
n-grams; the different ones of up to ORDER + 1 bytes, of both classes, are collected and
broadcast, so a model grows with them (README). Scoring is one pass over the url column;
only labelled URLs and counts move.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule, and a verdict by the method (null counts as empty; the symbol "end" is still
scored); without labelled URLs of both classes the threshold is 0, and a class that
has none is uniform; a score on the threshold is allowed; rows that repeat come out
as often; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, text_chunks

ALLOW, BLOCK = "allow", "block"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str = "/"


#: The rules of the query.
RULES = (Rule(ALLOW, "com"), Rule(BLOCK, "example.com", "/en/"), Rule(ALLOW, "www.example.com", "/en/"), Rule(BLOCK, "net", "/es/"), Rule(BLOCK, "net", "/fr/"))
#: Bytes of the longest context.
ORDER = 5
#: Occurrences in its class that make a context count.
MIN_SEEN = 2
#: Bytes of the longest URL of a sample, if one is asked for.
LONGEST = 2048
#: One of so many labelled URLs calibrates.
HELD_OUT = 5
#: Steps of a threshold in one unit of the score, and the largest threshold.
STEPS, WIDEST = 256, 8
#: Symbols that no UTF-8 text has.
BEGIN, END = 0xFE, 0xFF
#: Positions that are looked up at once.
BLOCK_SIZE = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and what the models read: the URL from its host on."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(F.concat(host, tail), url, F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> Column:
    """struct<name, verdict> of the longest rule that fits, else null; of equally long
    ones that with the longer host, then the first of the list."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: (len(r.host) + len(r.path), len(r.host))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


class Markov:
    """A byte model of varying order from counts of its n-grams: ``grams[k]`` has sorted
    keys of k + 1 symbols, the oldest in the highest bits, and ``counts[k]`` their counts."""

    def __init__(self, grams: list[np.ndarray], counts: list[np.ndarray], least: int = MIN_SEEN):
        flat = np.full(256, 1 / 256)
        n = np.bincount(grams[0].astype(np.int64), counts[0], 256)
        kinds = np.count_nonzero(n)
        self.base = (n + kinds * flat) / (n.sum() + kinds) if kinds else flat
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below, lower = np.arange(256, dtype=np.uint64), self.base
        for k in range(1, len(grams)):
            gram, n = grams[k], counts[k].astype(float)
            ctx, first, group = np.unique(gram >> np.uint64(8), return_index=True, return_inverse=True)
            total = np.bincount(group, n, len(ctx))
            kinds = np.bincount(group, minlength=len(ctx)).astype(float)
            kept = total >= least
            some = kept[group]
            gram, n, group = gram[some], n[some], group[some]
            shorter = gram & np.uint64((1 << 8 * k) - 1)
            p = (n + kinds[group] * lower[np.searchsorted(below, shorter)]) / (total + kinds)[group]
            self.levels.append((ctx[kept], (kinds / (total + kinds))[kept], gram, p))
            below, lower = gram, p

    def logs(self, symbols: np.ndarray, depth: np.ndarray, begin: int) -> np.ndarray:
        """Natural log probabilities of ``symbols[begin:]``; ``depth``: how many symbols of
        the same text stand before each."""
        own = symbols[begin:]
        p, key = self.base[own], own.astype(np.uint64)
        place = np.arange(begin, len(symbols))
        for k, (ctx, weight, gram, prob) in enumerate(self.levels, 1):
            if not len(ctx):
                break
            key = key | (symbols[np.maximum(place - k, 0)].astype(np.uint64) << np.uint64(8 * k))
            at = np.minimum(np.searchsorted(ctx, key >> np.uint64(8)), len(ctx) - 1)
            known = (depth >= k) & (ctx[at] == key >> np.uint64(8))
            to = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
            p = np.where(known, np.where(gram[to] == key, prob[to], weight[at] * p), p)
        return np.log(p)


def framed(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with BEGIN and END around each, and where each starts."""
    n = len(off) - 1
    start = off + 2 * np.arange(n + 1)
    symbols = np.empty(len(data) + 2 * n, np.uint8)
    symbols[start[:-1]], symbols[start[1:] - 1] = BEGIN, END
    inside = np.ones(len(symbols), bool)
    inside[start[:-1]] = inside[start[1:] - 1] = False
    symbols[inside] = data
    return symbols, start


def ratios(models: Sequence[Markov], off: np.ndarray, data: np.ndarray, order: int) -> np.ndarray:
    """For each text the difference of its log-likelihoods by the two models, over its
    symbols (END counts, BEGIN doesn't)."""
    symbols, start = framed(off, data)
    out = np.zeros(len(off) - 1)
    for a in range(0, len(symbols), BLOCK_SIZE):
        b, back = min(a + BLOCK_SIZE, len(symbols)), max(0, a - order)
        row = np.searchsorted(start, np.arange(a, b), side="right") - 1
        depth = np.arange(a, b) - start[row]
        gain = models[0].logs(symbols[back:b], depth, a - back) - models[1].logs(symbols[back:b], depth, a - back)
        gain[depth == 0] = 0  # BEGIN is given
        first = row[0]
        out[first : row[-1] + 1] += np.bincount(row - first, gain)
    return out / np.maximum(np.diff(start) - 1, 1)


class Filter(NamedTuple):
    """Models of accepted and rejected URLs, and the least score that is allowed."""

    models: tuple[Markov, Markov]
    threshold: float
    order: int


def _counted(sample: DataFrame, order: int, least: int) -> tuple[Markov, Markov]:
    """The models of (verdict, text); counts of n-grams are summed by Spark."""

    def run(batches):
        for b in batches:
            for first, off, data in text_chunks(b.column(1), BLOCK_SIZE):
                symbols, start = framed(off, data)
                row = np.repeat(np.arange(len(off) - 1), np.diff(start))
                depth = np.arange(len(symbols)) - start[row]
                ok = np.array([v == ALLOW for v in b.column(0).slice(first, len(off) - 1).to_pylist()])[row]
                key = symbols.astype(np.uint64)
                for k in range(order + 1):
                    if k:
                        key = key | np.concatenate([np.zeros(min(k, len(symbols)), np.uint64), symbols[:-k].astype(np.uint64) << np.uint64(8 * k)])
                    for good in (True, False):
                        gram, n = np.unique(key[(depth >= max(k, 1)) & (ok == good)], return_counts=True)
                        cols = [pa.array(np.full(len(gram), good)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))]
                        yield pa.RecordBatch.from_arrays(cols, names=["ok", "k", "gram", "n"])

    counts = sample.select("verdict", "text").mapInArrow(run, "ok boolean, k int, gram long, n long")
    table = counts.groupBy("ok", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    good, k = table["ok"].to_numpy(), table["k"].to_numpy()
    gram, n = table["gram"].to_numpy().view(np.uint64), table["n"].to_numpy()
    models = []
    for own in (True, False):
        grams, times = [], []
        for i in range(order + 1):
            some = (good == own) & (k == i)
            by = np.argsort(gram[some])
            grams.append(gram[some][by])
            times.append(n[some][by])
        models.append(Markov(grams, times, least))
    return models[0], models[1]


def fit(labelled: DataFrame, sample_bytes: int | None = None, order: int = ORDER, least: int = MIN_SEEN) -> Filter:
    """A filter from (verdict, text); texts count once however often they occur. All are
    used, or, with ``sample_bytes``, about so many bytes of each class."""
    pick = lambda seed, n: F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(n))
    rows = labelled.select("verdict", "text")
    if sample_bytes is not None:
        rows = rows.filter(F.octet_length("text") <= LONGEST)
        seen = rows.groupBy("verdict").agg((F.approx_count_distinct("text") * F.avg(F.octet_length("text") + 1)).alias("bytes")).collect()
        odds = {r["verdict"]: min(1.0, sample_bytes / max(r["bytes"], 1.0)) for r in seen}
        limit = F.when(F.col("verdict") == ALLOW, odds.get(ALLOW, 0.0)).otherwise(odds.get(BLOCK, 0.0))
        rows = rows.filter(pick(1, 1 << 30) < limit * (1 << 30))
    sample = materialise(rows.distinct(), "urls")
    held = pick(2, HELD_OUT) == 0
    made = Filter(_counted(sample.filter(~held), order, least), 0.0, order)
    place = F.greatest(F.lit(-STEPS * WIDEST), F.least(F.lit(STEPS * WIDEST), F.floor(F.col("score") * STEPS))).cast("int")
    tried = scored(sample.filter(held).select("text", "verdict"), made).groupBy("verdict", place.alias("place")).agg(F.count("*").alias("n")).collect()
    bins = np.zeros((2, 2 * STEPS * WIDEST + 1))
    for r in tried:
        bins[int(r["verdict"] == ALLOW), r["place"] + STEPS * WIDEST] += r["n"]
    if not bins.sum(axis=1).all():
        return made
    rejected, accepted = bins / bins.sum(axis=1, keepdims=True)
    right = np.concatenate([[0], np.cumsum(rejected)[:-1]]) + np.cumsum(accepted[::-1])[::-1]  # of both classes, if scores from this step on are allowed
    at = np.flatnonzero(right > right.max() - 1e-12) - STEPS * WIDEST
    return made._replace(threshold=float(at[np.abs(at).argmin()]) / STEPS)


def scored(rows: DataFrame, made: Filter) -> DataFrame:
    """``rows`` (text first) with ``score`` in place of the text."""
    model, names = rows.sparkSession.sparkContext.broadcast(made), rows.columns[1:]

    def run(batches):
        own = model.value
        for b in batches:
            found = [ratios(own.models, off, data, own.order) for _, off, data in text_chunks(b.column(0), BLOCK_SIZE)]
            score = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], score], names=[*names, "score"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in names], "score double"]))


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", sample_bytes: int | None = None, order: int = ORDER, least: int = MIN_SEEN) -> DataFrame:
    """(page_id, host, path, rule, verdict, score, threshold) of every row."""
    host, path, text = parts(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"), text.alias("text"))
    rows = rows.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    made = fit(rows.filter("rule IS NOT NULL").select("rule.verdict", "text"), sample_bytes, order, least)
    out = scored(rows.select("text", "page_id", "host", "path", F.col("rule.name").alias("rule"), F.col("rule.verdict").alias("told")), made)
    method = F.when(F.col("score") >= made.threshold, ALLOW).otherwise(BLOCK)
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", method).alias("verdict"), "score", F.lit(made.threshold).alias("threshold"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
