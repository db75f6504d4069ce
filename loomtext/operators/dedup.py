"""Corpus dedup by character windows (K1) and by greedy entry overlap (K2).

Documents come as (ord, text); ``ord`` is the order in which a first copy wins.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.sources.shared import checkpointed, small

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


class _Hashes:
    """Two 64-bit hashes of any range of a text's code points, from sums over its prefixes."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = n = len(code)
        self.sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(code * _powers(base, n))]) for base in _BASES]
        self.back = [_powers(pow(base, -1, 1 << 64), n + 1) for base in _BASES]

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        out = []
        for total, back in zip(self.sums, self.back):
            h = (total[end] - total[start]) * back[start]
            out.append((h ^ (h >> np.uint64(29)) ^ (end - start).astype(np.uint64)).view(np.int64))
        return out


def _hashes(text: str, width: int, stride: int) -> list[np.ndarray]:
    """The hashes of each window of code points; of the whole text if short."""
    own = _Hashes(text)
    width = min(width, own.n)
    at = np.arange(0, own.n - width + 1, stride)
    return own.of(at, at + width)


def _runs(text: str, width: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that have their anchor in common: the place of the least hash of
    half a window's characters in a window. (anchor's hash, two hashes of all that the run
    covers, first window, windows). Equal windows have equal anchors, wherever they stand."""
    own, gram = _Hashes(text), max(1, width // 2)
    n = own.n - width + 1
    if n <= 0:  # shorter than a window
        h, g = own.of(np.zeros(1, np.int64), np.full(1, own.n))
        return h, h, g, np.zeros(1, np.int64), np.ones(1, np.int64)
    at = np.arange(own.n - gram + 1)
    rank = own.of(at, at + gram)[0].view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    rank ^= rank >> np.uint64(32)
    place = np.empty(n, np.int64)
    for a in range(0, n, 1 << 14):  # a slice of windows at once
        some = np.lib.stride_tricks.sliding_window_view(rank[a : a + (1 << 14) + width - gram], width - gram + 1)[: n - a][: 1 << 14]
        place[a : a + len(some)] = some.argmin(axis=1) + np.arange(a, a + len(some))
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    size = np.diff(np.concatenate([first, [n]]))
    h, g = own.of(first, first + size - 1 + width)
    return rank[place[first]].view(np.int64), h ^ (place[first] - first), g, first, size


def counted_windows(docs: DataFrame, width: int, stride: int = 1) -> DataFrame:
    """(ord, h, g, n): hash pairs of each text's different windows, one every ``stride``
    characters, and how many windows of the text each stands for."""

    def run(batches):
        for b in small(batches):
            rows = []
            for text in b.column(1).to_pylist():
                both = np.rec.fromarrays(_hashes(text or "", width, stride), names="h,g")
                by = np.lexsort((both.g, both.h))
                both = both[by]
                first = np.flatnonzero(np.concatenate([[True], (both.h[1:] != both.h[:-1]) | (both.g[1:] != both.g[:-1])]))
                rows.append((both.h[first], both.g[first], np.diff(np.concatenate([first, [len(by)]]))))
            own = b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), [len(r[0]) for r in rows])))
            yield pa.RecordBatch.from_arrays([own, *(pa.array(np.concatenate(c)) for c in zip(*rows))], names=["ord", "h", "g", "n"])

    return docs.select(F.col("ord").cast("long"), "text").mapInArrow(run, "ord long, h long, g long, n long")


def first_windows(docs: DataFrame, width: int = 100) -> DataFrame:
    """(ord, start, size): runs of windows, at every character, that occur for the first time.

    Runs that are equal as a whole are settled by their hashes, a row for some dozens of
    characters. Only where one anchor has different runs, the first of each kind are taken
    apart into windows, which the texts, read again, give."""

    def run(batches):
        for b in batches:
            for ord_, text in zip(b.column(0), b.column(1).to_pylist()):
                cols = _runs(text or "", width)
                own = pa.array(np.full(len(cols[0]), ord_.as_py()))
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, cols)], names=["ord", "anchor", "h", "g", "start", "size"])

    runs = docs.select("ord", "text").mapInArrow(run, "ord long, anchor long, h long, g long, start long, size long")
    first = checkpointed(runs.groupBy("anchor", "h", "g").agg(F.min(F.struct("ord", "start", "size")).alias("at")))
    kinds = first.groupBy("anchor").agg((F.count("*") > 1).alias("mixed"))
    told = checkpointed(first.join(kinds, "anchor").select("at.ord", "at.start", "at.size", "mixed"))
    apart = told.filter("mixed").groupBy("ord").agg(F.collect_list(F.struct("start", "size")).alias("runs"))

    def windows(batches):
        for b in batches:
            for ord_, text, own in zip(b.column(0), b.column(1).to_pylist(), b.column(2)):
                hashes = _Hashes(text or "")
                at, size = (own.values.field(i).to_numpy() for i in (0, 1))
                at = np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                h, g = hashes.of(at, np.minimum(at + width, hashes.n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), ord_.as_py())), pa.array(at), pa.array(h), pa.array(g)], names=["ord", "start", "h", "g"])

    each = docs.select("ord", "text").join(apart, "ord").mapInArrow(windows, "ord long, start long, h long, g long")
    least = each.groupBy("h", "g").agg(F.min(F.struct("ord", "start")).alias("at"))
    return told.filter("NOT mixed").select("ord", "start", "size").union(least.select("at.ord", "at.start", F.lit(1).cast("long")))


def precise(docs: DataFrame, width: int = 100) -> DataFrame:
    """(ord, text): of each text the windows that occur for the first time in the
    corpus, overlaps merged and gaps dropped, and a tail of over width/10 characters;
    the first ``width`` characters if nothing is left (K1)."""
    w = first_windows(docs, width).groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("start", "size"))).alias("kept"))
    joined = docs.select("ord", "text").join(w, "ord", "left")

    def run(batches):
        for b in batches:
            out = []
            for text, kept in zip(b.column(1).to_pylist(), b.column(2)):
                text = text or ""
                if not kept.is_valid:
                    out.append(text[:width])
                    continue
                parts, end = [], 0
                for p, n in zip(*(kept.values.field(i).to_pylist() for i in (0, 1))):
                    parts.append(text[max(p, end) : p + n - 1 + width])
                    end = max(end, p + n - 1 + width)
                if len(text) - end > width // 10:
                    parts.append(text[end:])
                out.append("".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["ord", "text"])

    return joined.mapInArrow(run, "ord long, text string")


def greedy(docs: DataFrame, width: int = 100, threshold: float = 0.8) -> DataFrame:
    """(ord, kept): an entry goes if at least ``threshold`` of its window hashes (one
    every width/4 characters) are in entries kept before it (K2).

    Exact without a serial pass: what is kept bounds a share from below, what is
    undecided from above; rounds repeat until the bounds decide every entry. The first
    undecided entry is decided in each round, and only windows of undecided entries go on.
    """
    if threshold <= 0:
        return docs.select("ord", F.lit(False).alias("kept"))
    hashes = checkpointed(counted_windows(docs, width, max(1, width // 4)))
    shared = hashes.groupBy("h", "g").agg(F.min("ord").alias("first"), F.max("ord").alias("last")).filter("first < last")
    size = hashes.groupBy("ord").agg(F.sum("n").alias("size"))
    linked = hashes.join(shared.select("h", "g"), ["h", "g"]).join(size, "ord")
    undecided = checkpointed(linked.select("ord", "size", "h", "g", "n"))
    alone = docs.select("ord").join(undecided.select("ord").distinct(), "ord", "left_anti")
    decided = [alone.select("ord", F.lit(True).alias("kept"))]
    kept = undecided.limit(0).select("h", "g", F.col("ord").alias("sure"))
    while not undecided.isEmpty():  # each round decides one entry at least
        open_ = undecided.groupBy("h", "g").agg(F.min("ord").alias("open"))
        seen = undecided.join(open_, ["h", "g"]).join(kept, ["h", "g"], "left")
        sure = F.coalesce(F.col("sure") < F.col("ord"), F.lit(False))
        may = sure | (F.col("open") < F.col("ord"))
        share = seen.groupBy("ord", "size").agg(F.sum(F.when(sure, F.col("n")).otherwise(0)).alias("lo"), F.sum(F.when(may, F.col("n")).otherwise(0)).alias("hi"))
        new = F.when(F.col("lo") / F.col("size") >= threshold, False).when(F.col("hi") / F.col("size") < threshold, True)
        now = checkpointed(share.select("ord", new.alias("kept")).filter("kept IS NOT NULL"))
        decided.append(now)
        more = undecided.join(now.filter("kept"), "ord").select("h", "g", F.col("ord").alias("sure"))
        kept = checkpointed(kept.union(more).groupBy("h", "g").agg(F.min("sure").alias("sure")))
        undecided = checkpointed(undecided.join(now, "ord", "left_anti"))
        if len(decided) > 32:
            decided = [checkpointed(functools.reduce(DataFrame.union, decided))]
    return functools.reduce(DataFrame.union, decided)


def statistics(docs: DataFrame, mode: str = "efficient", width: int = 100, threshold: float = 0.8) -> DataFrame:
    """(seen, kept, removed, pct_removed) of a mode (K3): windows of "precise" (K1),
    entries of "efficient" (K2)."""
    if mode == "precise":
        some = docs.filter("text IS NOT NULL")
        seen = some.agg(F.coalesce(F.sum(F.greatest(F.length("text") - (width - 1), F.lit(1))), F.lit(0)).cast("long").alias("seen"))
        got = seen.crossJoin(F.broadcast(first_windows(some, width).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("kept"))))
    else:
        got = greedy(docs, width, threshold).agg(F.count("*").alias("seen"), F.count_if("kept").alias("kept"))
    removed = F.col("seen") - F.col("kept")
    return got.select("seen", "kept", removed.alias("removed"), F.round(100.0 * removed / F.nullif(F.col("seen"), F.lit(0)), 6).alias("pct_removed"))


def deduplicate(docs: DataFrame, mode: str = "efficient", width: int = 100, threshold: float = 0.8) -> DataFrame:
    """(ord, text) of what a mode keeps (K3)."""
    if mode == "precise":
        return precise(docs, width)
    kept = greedy(docs, width, threshold).filter("kept").select("ord")
    return docs.select("ord", "text").join(kept, "ord", "left_semi")
