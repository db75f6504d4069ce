"""Operator 9: benchmark decontamination by winnowing.

Words are hashed, four words make a k-gram, and of every seven k-grams in a row
(ten words) the least hash is a fingerprint, the leftmost of equals. Ten words
that a text shares with an item hold the same seven k-grams in both, so the same
one is picked in both: every shared span of ten words meets in a fingerprint.
Hits are extended word by word to both sides and count where they reach ten.
An item of fewer words is one window, and its own fingerprint.

Item fingerprints are sent to all tasks while the items have at most ITEM_WORDS
words in all (checked by counting); beyond that they go in blocks of that size,
a pass over the documents for each, and the passes' spans are joined by content.

Words are compared by 64-bit hashes of their bytes, ten of them for a window.

Defined results: null and empty texts have no words; items without words never
occur; rows that repeat count once as items and come out as often as documents;
a null item_id is listed as an empty string; empty tables give n_hit 0 or an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import LOWER, STEP_BYTES, text_chunks

WINDOW = 10
KGRAM = 4
SPAN = WINDOW - KGRAM + 1
#: Words of items that are sent to tasks at once (8 bytes each, and as much again
#: for fingerprints).
ITEM_WORDS = 1 << 21

_LOW = np.frombuffer(LOWER, np.uint8)
_WORD = np.array([48 <= c <= 57 or 97 <= c <= 122 or c >= 128 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(base: int, n: int, held={}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


def words_of(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text and the end) of a run of texts."""
    low = _LOW[data]
    word = np.concatenate([[False], _WORD[low], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(low)))])
    h = (total[end] - total[start]) * _powers(_INVERSE, len(low) + 1)[start] if len(start) else np.zeros(0, np.uint64)
    return _mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, off)


def _ngrams(h: np.ndarray, n: int) -> np.ndarray:
    m = max(0, len(h) - n + 1)
    g = np.zeros(m, np.uint64)
    for i in range(n):
        g = _mix(g * np.uint64(_BASE) + h[i : i + m])
    return g


def _winnow(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, fingerprints) that some whole window of a text picks."""
    g = _ngrams(h, KGRAM)
    if len(g) < SPAN:
        return np.zeros(0, np.int64), g[:0]
    view = np.lib.stride_tricks.sliding_window_view(g, SPAN)
    row = np.searchsorted(first, np.arange(len(h)), side="right")
    whole = np.flatnonzero(row[: len(view)] == row[WINDOW - 1 :])
    least, pick = view[:, 0].copy(), np.zeros(len(view), np.int64)
    for i in range(1, SPAN):
        less = view[:, i] < least
        least[less] = view[less, i]
        pick[less] = i
    at = np.unique(whole + pick[whole])
    return at, g[at]


class Items:
    """Items ready for matching: ``rows`` are (item_id, text)."""

    def __init__(self, rows: list[tuple]):
        texts = pa.array([t for _, t in rows], pa.large_string())
        self.ids = ["" if i is None else str(i) for i, _ in rows]
        hashes, sizes = [], []
        for _, off, data in text_chunks(texts, STEP_BYTES):
            h, first = words_of(off, data)
            hashes.append(h)
            sizes.append(np.diff(first))
        size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        item = np.repeat(np.arange(len(size)), size)
        at, fp = _winnow(self.words, self.first[:-1])
        order = np.argsort(fp, kind="stable")
        self.fp, self.at, self.item = fp[order], at[order], item[at][order] if len(at) else at
        self.short = {}
        for n in range(1, WINDOW):
            own = np.flatnonzero(size == n)
            if len(own):
                g = _ngrams(self.words, n)[self.first[own]]
                order = np.argsort(g, kind="stable")
                self.short[n] = g[order], own[order]

    def spans(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item): words of a run of texts inside occurring windows."""
        found = []
        row = np.searchsorted(first, np.arange(len(h)), side="right")
        at, fp = _winnow(h, first)
        for own, item in self._pairs(at, fp):
            n = len(own)
            left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for side, reach, step in ((left, own, -1), (right, own, 1)):
                going = np.ones(n, bool)
                for i in range(1, SPAN if step < 0 else WINDOW):
                    a, b = own + step * i, self.at[item] + step * i
                    ok = (a >= 0) & (a < len(h)) & (b >= 0) & (b < len(self.words))
                    a, b = np.where(ok, a, 0), np.where(ok, b, 0)
                    same = (h[a] == self.words[b]) & (row[a] == row[own]) & (b >= self.first[self.item[item]]) & (b < self.first[self.item[item] + 1])
                    going &= ok & same
                    side += going
            good = (left + right + 1 >= WINDOW) & (h[own] == self.words[self.at[item]])
            found.append(np.stack([own - left, own + right + 1, self.item[item]])[:, good])
        for n, (g, item) in self.short.items():
            own = _ngrams(h, n)
            place = np.arange(len(own))
            whole = row[: len(own)] == row[n - 1 :] if len(own) else place.astype(bool)
            lo, hi = np.searchsorted(g, own, "left"), np.searchsorted(g, own, "right")
            many = np.where(whole, hi - lo, 0)
            start = np.repeat(place, many)
            k = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            found.append(np.stack([start, start + n, item[k]]))
        return tuple(np.concatenate(found, axis=1)) if found else (np.zeros(0, np.int64),) * 3

    def _pairs(self, at, fp, step: int = 1 << 18):
        """Blocks of (position in the run, index into the fingerprints)."""
        lo, hi = np.searchsorted(self.fp, fp, "left"), np.searchsorted(self.fp, fp, "right")
        hit = np.flatnonzero(hi > lo)
        many, a = (hi - lo)[hit], 0
        ends = np.cumsum(many)
        while a < len(hit):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + step)))
            n = many[a:b]
            yield np.repeat(at[hit[a:b]], n), np.repeat(lo[hit[a:b]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a = b


def item_blocks(benchmark: DataFrame, item_words: int = ITEM_WORDS):
    """The items with at least a character, in blocks of about ``item_words`` words."""
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("text IS NOT NULL AND text <> ''").distinct().orderBy("item_id", "text")
    held, n = [], 0
    for r in rows.toLocalIterator():
        held.append((r[0], r[1]))
        n += len(r[1]) // 2 + 1
        if n >= item_words:
            yield held
            held, n = [], 0
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_words: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for
    each input row. ``spans`` of each block travel with the row from pass to pass,
    so that no join is needed."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = item_blocks(benchmark, item_words)
    block, done = next(blocks), False
    rows = docs.withColumn("hits", F.lit(None).cast("binary")).withColumn("items", F.lit(None).cast("array<string>"))
    while not done:
        following = next(blocks, None)
        done = following is None
        rows = _pass(rows, block, done)
        block = following
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _pass(rows: DataFrame, block: list[tuple], last: bool) -> DataFrame:
    model = rows.sparkSession.sparkContext.broadcast(block)  # at most item_words words
    held = {}

    def run(batches):
        items = held.get("items") or held.setdefault("items", Items(model.value))
        for b in batches:
            bits, names, words, hits = [], [], [], []
            before, listed = b.column(2), b.column(3)
            for start, off, data in text_chunks(b.column(1), STEP_BYTES):
                h, first = words_of(off, data)
                n = len(off) - 1
                lo, hi, item = items.spans(h, first[:-1])
                mark = np.zeros(len(h) + 1, np.int64)
                np.add.at(mark, lo, 1)
                np.add.at(mark, hi, -1)
                hit = np.cumsum(mark[:-1]) > 0
                of = np.searchsorted(first[1:], lo, side="right")
                mine = [set() for _ in range(n)]
                for r, i in set(zip(of.tolist(), item.tolist())):
                    mine[r].add(items.ids[i])
                for r in range(n):
                    own, old = hit[first[r] : first[r + 1]], before[start + r].as_py()
                    if old is not None:
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
                        mine[r] |= set(listed[start + r].as_py() or ())
                    words.append(len(own))
                    hits.append(int(own.sum()))
                    names.append(sorted(mine[r]))
                    bits.append(None if last else np.packbits(own).tobytes())
            names = pa.array(names, pa.list_(pa.string()))
            if last:
                out = [b.column(0), names, pa.array(words, pa.int64()), pa.array(hits, pa.int64())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "items", "n_words", "n_hit"])
            else:
                out = [b.column(0), b.column(1), pa.array(bits, pa.binary()), names]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "text", "hits", "items"])

    schema = "doc_id long, items array<string>, n_words long, n_hit long" if last else "doc_id long, text string, hits binary, items array<string>"
    return rows.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, item_words: int = ITEM_WORDS) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    names = docs.columns
    for block in item_blocks(benchmark, item_words):
        docs = _clean_pass(docs, block, names.index("text"))
    return docs


def _clean_pass(docs: DataFrame, block: list[tuple], text: int) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(block)
    held = {}

    def run(batches):
        items = held.get("items") or held.setdefault("items", Items(model.value))
        for b in batches:
            clean = np.ones(b.num_rows, bool)
            for start, off, data in text_chunks(b.column(text), STEP_BYTES):
                h, first = words_of(off, data)
                lo = items.spans(h, first[:-1])[0]
                clean[start + np.searchsorted(first[1:], lo, side="right")] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
