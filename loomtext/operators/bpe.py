"""Training of a small word-based BPE, greedy encoding and decoding (K4-K7).

Words are counted on the cluster. Where ``max_words`` distinct words hold them all, the
merge loop runs on the driver, with pair counts kept up to date through an index from
pairs to words. More words stay on the cluster as symbol numbers. A round counts their
pairs, cuts the words wherever a pair is rarer than the most frequent ones, and gives the
driver the different pieces that are left, of which there are few; from these it finds
the next merges, as long as no pair that was cut could be as frequent. Both ways give the
same merges: the most frequent pair, and of equals the one that comes first in the words
as they are now, by a word's first occurrence.
"""

from __future__ import annotations

import heapq
import itertools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.numbering import numbered
from loomtext.sources.shared import checkpointed

MARK = "Ġ"
#: Most frequent pairs that the driver sees in a round.
_TOP = 4096
#: Different pieces of words that the driver takes in a round.
_PIECES = 100_000
#: Merges that may be waiting before the cluster's words are written anew.
_WAITING = 256
#: A word's place is its number by first occurrence times this, plus a character's offset.
_WORD = 1 << 27
#: The first number of a merged symbol; those below are code points.
_MERGED = 0x110000

Pair = tuple[str, str]


def _words(text: str | None) -> list[str]:
    return [w if i == 0 else MARK + w for i, w in enumerate(x for x in (text or "").split(" ") if x)]


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n, first): words of (doc_id, text), all but a text's first with MARK. A
    batch's equal words are a row."""

    def run(batches):
        for b in batches:
            n, first = Counter(), {}
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0)):
                words = _words(texts[i])
                n.update(words)
                for pos, w in enumerate(words):
                    if w not in first:
                        first[w] = (ids[i], pos)
            at = [pa.array(c, t) for c, t in zip(zip(*first.values()) if first else ((), ()), (pa.int64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(first), pa.string()), pa.array([n[w] for w in first], pa.int64()), *at], names=["word", "n", "doc_id", "pos"])

    each = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long, doc_id long, pos int")
    return each.groupBy("word").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"))


class _Held:
    """Words, or pieces of words, in memory: symbols, frequency and place of each."""

    def __init__(self, words: list[list[str]], freq: list[int], place: list[int]):
        self.words, self.freq, self.at = words, freq, place
        self.pairs, self.where = Counter(), defaultdict(set)
        for i, w in enumerate(self.words):
            for p in zip(w, w[1:]):
                self.pairs[p] += self.freq[i]
                self.where[p].add(i)
        self.heap = [(-n, p) for p, n in self.pairs.items()]
        heapq.heapify(self.heap)

    def symbols(self) -> set[str]:
        return {c for w in self.words for c in w}

    def tokens(self) -> int:
        return sum(len(w) * n for w, n in zip(self.words, self.freq))

    def best(self) -> list[tuple[Pair, int]]:
        equal, most = set(), 0
        while self.heap and -self.heap[0][0] >= most:
            n, p = heapq.heappop(self.heap)
            if self.pairs.get(p) == -n:  # else an entry of before
                most = -n
                equal.add(p)
        if not equal:
            return []
        first = min(equal, key=self._place) if len(equal) > 1 else next(iter(equal))
        for p in equal:
            heapq.heappush(self.heap, (-most, p))
        return [(first, most)]

    def _place(self, pair) -> int:
        least = None
        for i in self.where[pair]:
            if least is None or self.at[i] < least:
                w, at = self.words[i], self.at[i]
                for k in range(len(w) - 1):
                    if (w[k], w[k + 1]) == pair:
                        break
                    at += len(w[k])
                least = at if least is None else min(least, at)
        return least

    def merge(self, pairs: list[Pair]) -> set[Pair]:
        (pair,) = pairs
        new, touched = "".join(pair), set()
        for i in sorted(self.where[pair]):
            w, n = self.words[i], self.freq[i]
            for p in zip(w, w[1:]):
                self.pairs[p] -= n
                self.where[p].discard(i)
                touched.add(p)
            self.words[i] = w = _pass(w, {pair: new})
            for p in zip(w, w[1:]):
                self.pairs[p] += n
                self.where[p].add(i)
                touched.add(p)
        for p in touched:
            if self.pairs[p] > 0:
                heapq.heappush(self.heap, (-self.pairs[p], p))
            else:
                del self.pairs[p], self.where[p]
        return touched


class _Driver(_Held):
    """Distinct words in memory."""

    def __init__(self, counts: DataFrame):
        rows = counts.orderBy("first", "word").collect()
        super().__init__([list(r["word"]) for r in rows], [r["n"] for r in rows], [i * _WORD for i in range(len(rows))])


class _Cluster:
    """Distinct words as a table (place, n, w) of symbol numbers."""

    def __init__(self, counts: DataFrame):
        def run(batches):
            for b in batches:
                text = "".join(b.column(2).to_pylist()).encode("utf-32-le")
                own = pa.array(np.frombuffer(text, np.int32))
                off = np.concatenate([[0], np.cumsum(pc.utf8_length(b.column(2)).to_numpy(zero_copy_only=False))]).astype(np.int32)
                place = pa.array(b.column(0).to_numpy() * _WORD)
                yield pa.RecordBatch.from_arrays([place, b.column(1), pa.ListArray.from_arrays(pa.array(off), own)], names=["place", "n", "w"])

        rows = numbered(counts, ["first", "word"], "id", 0).select("id", "n", "word")
        self.words = checkpointed(rows.mapInArrow(run, "place long, n long, w array<int>"))
        self.waiting: list[tuple[int, int, int]] = []
        self.names, self.numbers = [], {}
        self.hot = max(1, _TOP // 64)

    def _number(self, symbol: str) -> int:
        return ord(symbol) if len(symbol) == 1 else self.numbers[symbol]

    def _name(self, number: int) -> str:
        return chr(number) if number < _MERGED else self.names[number - _MERGED]

    def _lengths(self) -> np.ndarray:
        return np.array([len(s) for s in self.names], np.int64)

    def symbols(self) -> set[str]:
        return {chr(c) for c in self._chars()}

    def tokens(self) -> int:
        return sum(self._chars().values())

    def _chars(self) -> dict[int, int]:
        """How often each code point occurs, before any merge."""
        if not hasattr(self, "chars"):

            def run(batches):
                for b in batches:
                    own, off = _flat(b.column(2))
                    yield _summed(own.astype(np.int64), np.repeat(b.column(1).to_numpy(), np.diff(off)))

            rows = self.words.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()
            self.chars = {r["key"]: r["n"] for r in rows}
        return self.chars

    def _pairs(self) -> DataFrame:
        """(key, n, at) of every pair: its number, how often it occurs, and its first place."""
        waiting, long = self.waiting, self._lengths()

        def run(batches):
            for b in batches:
                own, place, row = _merged(b, waiting, long)
                at = np.flatnonzero(row[1:] == row[:-1])
                yield _summed(_keys(own, at), b.column(1).to_numpy()[row[at]], place[at])

        pairs = self.words.mapInArrow(run, "key long, n long, at long")
        return pairs.groupBy("key").agg(F.sum("n").alias("n"), F.min("at").alias("at"))

    def best(self) -> list[tuple[Pair, int]]:
        """The next merges, in order, with the counts they have by then."""
        top = self._pairs().orderBy(F.col("n").desc(), "at").limit(_TOP + 1).collect()
        named = lambda key: (self._name(key >> 32), self._name(key & 0xFFFFFFFF))
        if not top:
            return []
        while True:
            rest = top[self.hot]["n"] if self.hot < len(top) else 0 if len(top) <= _TOP else top[-1]["n"]
            hot = [r for r in top if r["n"] > rest]
            if not hot and self.hot < min(len(top), _TOP):
                self.hot = min(_TOP, 2 * self.hot)
                continue
            rows = self._pieces([r["key"] for r in hot]) if hot else []
            if hot and len(rows) <= _PIECES:
                break
            if not hot or top[0]["n"] == hot[-1]["n"]:  # too many are equal
                return independent([(named(r["key"]), r["n"]) for r in top], len(top) <= _TOP)
            self.hot = max(1, min(self.hot, len(hot)) // 4)  # fewer pairs, shorter pieces
        if len(rows) < _PIECES // 4:
            self.hot = min(_TOP, 2 * self.hot)
        words = [[self._name(c) for c in np.frombuffer(r["piece"], np.int32).tolist()] for r in rows]
        held = _Held(words, [r["n"] for r in rows], [r["at"] for r in rows])
        return _foreseen(held, {named(r["key"]) for r in hot}, rest, self.numbers)

    def _pieces(self, hot: list[int]) -> list:
        """(piece, n, at): stretches of words between pairs that aren't ``hot``; no more
        than one beyond the limit."""
        waiting, long, known = self.waiting, self._lengths(), np.sort(np.array(hot, np.int64))

        def run(batches):
            for b in batches:
                own, place, row = _merged(b, waiting, long)
                joined = np.zeros(len(own) + 1, bool)  # a symbol with the one before
                at = np.flatnonzero(row[1:] == row[:-1])
                key = _keys(own, at)
                joined[at[known[np.minimum(np.searchsorted(known, key), len(known) - 1)] == key] + 1] = True
                inside = joined[:-1] | joined[1:]
                first = ~joined[:-1] & joined[1:]
                begin = np.flatnonzero(first)
                off = np.concatenate([np.flatnonzero(first[inside]), [inside.sum()]]).astype(np.int32) * 4
                piece = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(off), pa.py_buffer(own[inside].astype(np.int32).tobytes())])
                yield pa.RecordBatch.from_arrays([piece, pa.array(b.column(1).to_numpy()[row[begin]]), pa.array(place[begin])], names=["piece", "n", "at"])

        rows = self.words.mapInArrow(run, "piece binary, n long, at long").groupBy("piece").agg(F.sum("n").alias("n"), F.min("at").alias("at"))
        return rows.limit(_PIECES + 1).collect()

    def merge(self, pairs: list[Pair]) -> None:
        for pair in pairs:
            new = "".join(pair)
            if new not in self.numbers:
                self.numbers[new] = _MERGED + len(self.names)
                self.names.append(new)
            self.waiting.append((*map(self._number, pair), self.numbers[new]))
        if len(self.waiting) < _WAITING:
            return
        waiting, long = self.waiting, self._lengths()

        def run(batches):
            for b in batches:
                own, _, row = _merged(b, waiting, long)
                off = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
                w = pa.ListArray.from_arrays(pa.array(off), pa.array(own.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), w], names=["place", "n", "w"])

        self.words, self.waiting = checkpointed(self.words.mapInArrow(run, self.words.schema)), []


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """All elements of a column of lists, and where each list starts."""
    off = column.offsets.to_numpy()
    return column.values.to_numpy()[off[0] : off[-1]], off - off[0]


def _merged(batch: pa.RecordBatch, waiting: list[tuple[int, int, int]], long: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of a batch's words after the merges, the place of each, and its row; ``long``
    has the lengths of merged symbols."""
    own, off = _flat(batch.column(2))
    size, row = len(own), np.repeat(np.arange(batch.num_rows), np.diff(off))
    chars = np.ones(size, np.int64)
    chars[own >= _MERGED] = long[own[own >= _MERGED] - _MERGED]
    before = np.concatenate([[0], np.cumsum(chars)])
    place = batch.column(0).to_numpy()[row] + before[:-1] - before[off[:-1]][row]
    own = np.concatenate([own, [-1]]).astype(np.int32)  # -1: no symbol
    after = np.arange(1, size + 1)  # the next symbol of the word
    after[off[1:][np.diff(off) > 0] - 1] = size
    for left, right, new in waiting:
        at = np.flatnonzero(own == left)
        to = after[at]
        some = own[to] == right
        at, to = at[some], to[some]
        if left == right and len(at):  # of a run, from left to right
            k = np.arange(len(at))
            begin = np.concatenate([[True], at[1:] != to[:-1]])
            even = (k - np.maximum.accumulate(np.where(begin, k, 0))) % 2 == 0
            at, to = at[even], to[even]
        own[at], own[to], after[at] = new, -1, after[to]
    kept = np.flatnonzero(own >= 0)
    return own[kept].astype(np.int64), place[kept], row[kept]


def _keys(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    return own[at] << 32 | own[at + 1]


def _summed(key: np.ndarray, n: np.ndarray, at: np.ndarray | None = None) -> pa.RecordBatch:
    """(key, n, at): of equal keys the sum and the least place."""
    by = np.argsort(key, kind="stable")
    key, n = key[by], n[by]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    cols = [key[first], np.add.reduceat(n, first) if len(key) else n]
    if at is not None:
        cols.append(np.minimum.reduceat(at[by], first) if len(key) else at)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["key", "n", "at"][: len(cols)])


def _foreseen(held: _Held, hot: set[Pair], rest: int, known: dict[str, int]) -> list[tuple[Pair, int]]:
    """The merges that pieces of words tell. The pieces hold every occurrence of the ``hot``
    pairs; a pair at a cut occurs ``rest`` times at most. A pair of later symbols may stand
    at the cuts between what its left one ends with and its right one starts with, in
    symbols of now: it's sure if none of these is a cut, and else its count lies within as
    many times ``rest`` from what the pieces show. ``known``: merged symbols of before."""
    out: list[tuple[Pair, int]] = []
    starts, ends, doubted, made = {}, {}, {}, set()
    of = lambda held, symbol: held.get(symbol, {symbol})
    cuts = lambda p: sum((s, t) not in hot for s in of(ends, p[0]) for t in of(starts, p[1])) if rest else 0
    most = [1, 1]
    while len(out) < _WAITING and (best := held.best()):
        pair, n = best[0]
        if n <= rest * most[0] * most[1] or cuts(pair) or any(held.pairs.get(p, 0) + rest * c >= n for p, c in doubted.items()):
            break
        out.append((pair, n))
        new = "".join(pair)
        again = new in known or new in made
        for i, (sets, part) in enumerate(((starts, pair[0]), (ends, pair[1]))):
            sets[new] = (of(sets, new) if again else set()) | of(sets, part)
            most[i] = max(most[i], len(sets[new]))
        touched = held.merge([pair])
        made.add(new)
        for p in held.pairs if again else touched:
            if new in p and p in held.pairs and (c := cuts(p)):
                doubted[p] = c
    return out


def independent(top: list[tuple[Pair, int]], complete: bool) -> list[tuple[Pair, int]]:
    """The pairs, in order, that one merge after another would take as they are counted now.

    Merging (a, b) changes the counts of pairs that end in a or start with b, and makes
    new pairs no more frequent than those. So the next pair of the list is the next merge
    if it isn't one of these, and none of these is as frequent; were one more frequent, it
    would have come before. ``complete``: no pair is missing from the list."""
    chosen: list[tuple[Pair, int]] = []
    lefts, rights = set(), set()
    touched = lambda p: p[0] in rights or p[1] in lefts
    for k, (pair, n) in enumerate(top):
        if chosen:
            equal = (q for q, m in itertools.takewhile(lambda x: x[1] == n, top[k:]))
            if any(map(touched, equal)) or (not complete and n == top[-1][1]):
                break
        chosen.append((pair, n))
        lefts.add(pair[0])
        rights.add(pair[1])
    return chosen


def train(docs: DataFrame, vocabulary: int, target: float | None = None, min_frequency: int = 1, min_gain: float = 0.0, max_words: int = 50_000) -> DataFrame:
    """(rank, left, right, merged): merges until ``vocabulary`` symbols; with ``target``,
    until tokens are that share of characters, a pair is rarer than ``min_frequency``, or,
    past 1000 symbols, a merge gains less than ``min_gain`` (K5)."""
    counts = checkpointed(word_counts(docs))
    held: _Driver | _Cluster = (_Driver if counts.count() <= max_words else _Cluster)(counts)
    symbols = held.symbols()
    tokens = chars = held.tokens()
    merges: list[tuple[int, str, str, str]] = []
    going = True
    while going and len(symbols) < vocabulary and (top := held.best()):
        taken = []
        for pair, gain in top:
            going = gain >= min_frequency and (target is None or (tokens / max(1, chars) > target and (len(symbols) <= 1000 or gain / max(1, tokens) >= min_gain)))
            if not going or len(symbols) >= vocabulary:
                break
            new = "".join(pair)
            taken.append(pair)
            merges.append((len(merges), *pair, new))
            symbols.add(new)
            tokens -= gain
        if taken:
            held.merge(taken)
    return docs.sparkSession.createDataFrame(merges, "rank int, left string, right string, merged string")


def _pass(w: list[str], known: dict[Pair, str]) -> list[str]:
    """One pass from left to right in which any known pair merges."""
    out, i = [], 0
    while i < len(w):
        new = known.get((w[i], w[i + 1])) if i + 1 < len(w) else None
        out.append(w[i] if new is None else new)
        i += 1 if new is None else 2
    return out


def _greedy(word: str, known: dict[Pair, str]) -> list[str]:
    """Passes until none merges anything (K6)."""
    w = list(word)
    while len(out := _pass(w, known)) < len(w):
        w = out
    return w


def encode(docs: DataFrame, merges: DataFrame) -> DataFrame:
    """(doc_id, tokens): each distinct word of a batch is encoded once. The merge table
    has as many rows as training was asked for symbols."""
    known = docs.sparkSession.sparkContext.broadcast({(r["left"], r["right"]): r["merged"] for r in merges.collect()})

    def run(batches):
        for b in batches:
            held, out = {}, []
            for text in b.column(1).to_pylist():
                words = _words(text)
                for w in words:
                    if w not in held:
                        held[w] = _greedy(w, known.value)
                out.append([t for w in words for t in held[w]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["doc_id", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, tokens array<string>")


def decode(encoded: DataFrame) -> DataFrame:
    """(doc_id, text): tokens joined, MARK a space (K7)."""
    return encoded.select("doc_id", F.replace(F.array_join("tokens", ""), F.lit(MARK), F.lit(" ")).alias("text"))
