"""Operator 7: language-model scores by a weighted backoff automaton.

The model is a word trigram with Dirichlet smoothing down to single words,

    p(w)    = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w|h)  = (c(hw) + K p(w|h')) / (c(h) + K),   h' = h without its first word

as an automaton. Its states are the histories that training texts have: the empty
one, "begin", words, and pairs of words. A state has an arc for each word that
followed its history, of weight p(w|h), to the longest history that is a state; and a
failure arc, of weight K / (c(h) + K), to h'. The empty state has an arc for any
word. A text is read once from left to right from "begin": where the state lacks an
arc for the next word, failure arcs are followed until one has it. The state is
carried on, logarithms of all weights passed are added up, and "end" leads back to
"begin" for the next text.

No task ever holds the model. Texts are packed into blocks of about BLOCK_BYTES; a
block asks for the counts of exactly the n-grams that it contains, and builds its
slice of the automaton from the answers. N-grams are hashes (64 bits for words, 52
for pairs and triples), dealt evenly to partitions by the hash itself; a partition
adds up the counts of all blocks and answers each in the order of its question. Hot
words cost one entry a block. No count is pruned.

Defined results: null and empty texts are the token "end" alone; rows that repeat
count and come out as often; a null doc_id is trained on; with nothing to train
on all counts are 0; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import CHUNK_BYTES, LOWER, crc_mod, materialise, text_chunks

K = 4.0
#: Text of a block, and question bytes for which a partition is added.
BLOCK_BYTES = CHUNK_BYTES
PARTITION_BYTES = 24 << 20
#: Questions take about so many bytes for each byte of a compressed text.
_ASKED = 4
#: Tokens for which arcs are in memory at once.
_SLICE = 1 << 14

_LOW = np.frombuffer(LOWER, np.uint8)
_WORD = np.array([not (c == 32 or 9 <= c <= 13) for c in range(256)])
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_END, _BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bits of the hashes of words, pairs and triples.
_BITS = (64, 52, 52)


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int, held={}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


def tokens(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the words, with an end after each text; text of each)."""
    low = _LOW[data]
    word = np.concatenate([[False], _WORD[low], [False]])
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(low)))])
    h = (total[end] - total[start]) * _powers(_INVERSE, len(low) + 1)[start]
    h = _mix(_mix(h + (end - start).astype(np.uint64)))
    n = len(off) - 1
    first = np.searchsorted(start, off)
    size = np.diff(first)
    row = np.repeat(np.arange(n), size)
    out = np.full(len(h) + n, _END, np.uint64)
    out[np.arange(len(h)) + row] = h
    return out, np.repeat(np.arange(n), size + 1)


def grams(tok: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """Hashes of the word, the pair and the triple that end at each token. A pair's
    first word may be "begin"; a text's first token ends no triple (its last entry is
    that of the pair, to be left out by ``_inner``)."""
    join = lambda h, w: _mix(h * np.uint64(_BASE) + _mix(w)) >> np.uint64(64 - _BITS[1])
    before = np.empty_like(tok)
    before[1:] = tok[:-1]
    before[~_inner(row)] = _BEGIN
    pair = join(before, tok)
    ahead = np.empty_like(tok)
    ahead[1:] = pair[:-1]
    ahead[:1] = 0
    return [tok, pair, join(ahead + np.uint64(1), tok)]


def _inner(row: np.ndarray) -> np.ndarray:
    """Which tokens aren't the first of their text."""
    inner = np.zeros(len(row), bool)
    inner[1:] = row[1:] == row[:-1]
    return inner


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, ids, train, off, body): blocks of whole texts, bodies compressed."""

    def run(batches):
        seen = 0
        for b in batches:
            for first, off, data in text_chunks(b.column(1), BLOCK_BYTES):
                n = len(off) - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([seen]),
                        pa.array([b.column(0).slice(first, n).to_pylist()], pa.list_(pa.int64())),
                        pa.array([b.column(2).slice(first, n).to_pylist()], pa.list_(pa.bool_())),
                        pa.array([off.tobytes()], pa.binary()),
                        pa.array([zstandard.compress(data.tobytes(), 1)], pa.binary()),
                    ],
                    names=["seq", "ids", "train", "off", "body"],
                )
                seen += 1

    packed = docs.mapInArrow(run, "seq long, ids array<long>, train array<boolean>, off binary, body binary")
    key = F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("seq")
    return packed.select(key.alias("block"), "ids", "train", "off", "body")


def _planes(x: np.ndarray) -> bytes:
    """Byte by byte of all numbers: high bytes are mostly zero and compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _flat(raw: bytes, kind, at: int, n: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def _packed(arrays: list[np.ndarray]) -> bytes:
    """Three arrays of one kind, with their lengths ahead."""
    sizes = np.array([len(x) for x in arrays], np.int32).tobytes()
    return zstandard.compress(sizes + b"".join(map(_planes, arrays)), 1)


def _unpacked(body: bytes, kind) -> list[np.ndarray]:
    raw = zstandard.decompress(body)
    out, at = [], 12
    for n in np.frombuffer(raw, np.int32, 3).tolist():
        out.append(_flat(raw, kind, at, n))
        at += n * np.dtype(kind).itemsize
    return out


def _edges(parts: int, bits: int) -> np.ndarray:
    """Where the hash ranges of partitions start, but for the first."""
    step = (1 << bits) // parts
    return np.array([i * step for i in range(1, parts)], np.uint64)


def _read(off, body):
    return np.frombuffer(off, np.int64), np.frombuffer(zstandard.decompress(body), np.uint8)


def _questions(off: np.ndarray, data: np.ndarray):
    """A block's tokens, their texts, and for each order its distinct n-grams in order
    and which of them each token ends (-1: none)."""
    tok, row = tokens(off, data)
    keys, at = [], []
    for order, own in enumerate(grams(tok, row)):
        some = _inner(row) if order == 2 else np.ones(len(row), bool)
        k, i = np.unique(own[some], return_inverse=True)
        where = np.full(len(tok), -1, np.int64)
        where[some] = i
        keys.append(k)
        at.append(where)
    return tok, row, keys, at


def _learned(train, row: np.ndarray, keys: list, at: list) -> list[np.ndarray]:
    """How often a block's training texts have each of its n-grams."""
    learn = np.array(train, bool)[row]
    return [np.bincount(i[learn & (i >= 0)], minlength=len(k)).astype(np.uint32) for k, i in zip(keys, at)]


def _ask(blocks: DataFrame, parts: int) -> DataFrame:
    """(part, block, keys, counts): a block's distinct n-grams of a partition, in
    order, and how often its training texts have them."""

    def run(batches):
        for b in batches:
            for block, train, off, body in zip(*(b.column(i) for i in range(4))):
                _, row, keys, at = _questions(*_read(off.as_py(), body.as_py()))
                counts = _learned(train.as_py(), row, keys, at)
                cuts = [np.r_[0, np.searchsorted(k, _edges(parts, bits)), len(k)] for k, bits in zip(keys, _BITS)]
                rows = []
                for p in range(parts):
                    span = [slice(c[p], c[p + 1]) for c in cuts]
                    if any(s.stop > s.start for s in span):
                        steps = [np.diff(k[s], prepend=np.uint64(0)) for k, s in zip(keys, span)]
                        rows.append((p, block.as_py(), _packed(steps), _packed([c[s] for c, s in zip(counts, span)])))
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
                cols = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays(cols, names=["part", "block", "keys", "counts"])

    return blocks.select("block", "train", "off", "body").mapInArrow(run, "part int, block long, keys binary, counts binary")


def _answer(asked: DataFrame, parts: int) -> DataFrame:
    """(block, part, counts, total, kinds): for each block how often all other blocks
    have what it asked for (often 0, which compresses well); block -1 has the
    partition's training tokens and words. A task has one partition's questions, of
    bounded size."""

    def solve(part: int, rows: list[tuple[int, bytes, bytes]]):
        keys = [[np.cumsum(d, dtype=np.uint64) for d in _unpacked(k, np.uint64)] for _, k, _ in rows]
        counts = [_unpacked(c, np.uint32) for _, _, c in rows]
        out = [[] for _ in rows]
        for order in range(3):
            every, at = np.unique(np.concatenate([k[order] for k in keys]), return_inverse=True)
            total = np.bincount(at, np.concatenate([c[order] for c in counts]), len(every)).astype(np.uint64)
            if order == 0:
                words = (int(total.sum()), int((total > 0).sum()))
            a = 0
            for k, c, own in zip(keys, counts, out):
                own.append(total[at[a : a + len(k[order])]] - c[order])
                a += len(k[order])
        blocks = [*(r[0] for r in rows), -1]
        n = len(blocks)
        cols = [pa.array(blocks, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([*map(_packed, out), b""], pa.binary())]
        cols += [pa.array([0] * (n - 1) + [x], pa.int64()) for x in words]
        return pa.RecordBatch.from_arrays(cols, names=["block", "part", "counts", "total", "kinds"])

    def run(batches):
        now, rows = None, []
        for b in batches:
            for part, *own in zip(*(b.column(i).to_pylist() for i in range(4))):
                if part != now and rows:
                    yield solve(now, rows)
                    rows = []
                now = part
                rows.append(own)
        if rows:
            yield solve(now, rows)

    dealt = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part int, counts binary, total long, kinds long")


class Automaton:
    """A block's slice of the model, for the tokens of the block: states, their arcs and
    failure arcs. State 0 is the empty history, 1 "begin", then words, then pairs."""

    def __init__(self, tok, row, at, counts, total: int, kinds: int, starts: int, k: float = K):
        self.row, self.at, self.counts, self.k = row, at, counts, k
        word, pair = at[0], at[1]
        c1, c2 = counts[0], counts[1]
        self.words = len(c1)
        self.p1 = (c1 + 0.5) / (total + 0.5 * (kinds + 1))
        inner = _inner(row)
        before = np.r_[0, word[:-1]]
        #: The word state in which each token is read, if the pair before is none.
        self.low = np.where(inner, 2 + before, 1)
        self.end = np.unique(word[tok == _END])
        seen = np.r_[0, starts, c1]  # c(h) of the states up to words
        fail, back = np.zeros(2 + self.words + len(c2), np.int64), np.zeros(2 + self.words + len(c2))
        back[1 : 2 + self.words] = np.log10(k / (seen[1:] + k))
        fail[2 + self.words + pair] = 2 + word  # a pair falls back to its second word
        back[2 + self.words :] = np.log10(k / (c2 + k))
        self.fail, self.back, self.seen = fail.tolist(), back.tolist(), seen

    def arcs(self, a: int, b: int):
        """(state * words + word: arc; weights; targets) of the arcs that tokens a to b
        may take."""
        word, pair, triple = (x[a:b] for x in self.at)
        c1, c2, c3 = self.counts
        low, p1 = self.low[a:b], self.p1[word]
        p2 = (c2[pair] + self.k * p1) / (self.seen[low] + self.k)
        known, two = c1[word] > 0, c2[pair] > 0
        three = np.zeros(len(word), bool)
        three[triple >= 0] = c3[triple[triple >= 0]] > 0
        ahead = self.at[1][np.maximum(np.arange(a, b) - 1, 0)]  # the pair before a triple's last word
        p3 = (np.where(three, c3[triple], 0) + self.k * p2) / (c2[ahead] + self.k) if len(c3) else p2
        final = np.isin(word, self.end)
        to_word = np.where(final, 1, np.where(known, 2 + word, 0))
        to_pair = np.where(final, 1, 2 + self.words + pair)
        state = [np.zeros(b - a, np.int64), low[two], 2 + self.words + ahead[three]]
        keys = np.concatenate([s * self.words + w for s, w in zip(state, (word, word[two], word[three]))])
        weights = np.log10(np.concatenate([p1, p2[two], p3[three]]))
        return dict(zip(keys.tolist(), range(len(keys)))), weights.tolist(), np.concatenate([to_word, to_pair[two], to_pair[three]]).tolist()

    def read(self) -> list[float]:
        """Each text's log10 probability, in one traversal of all tokens."""
        out, state, score, end, words = [], 1, 0.0, set(self.end.tolist()), self.words
        fail, back = self.fail, self.back
        for a in range(0, len(self.row), _SLICE):
            arcs, weight, target = self.arcs(a, min(a + _SLICE, len(self.row)))
            find = arcs.get
            for w in self.at[0][a : a + _SLICE].tolist():
                arc = find(state * words + w)
                while arc is None:
                    score += back[state]
                    state = fail[state]
                    arc = find(state * words + w)
                score += weight[arc]
                state = target[arc]
                if w in end:
                    out.append(score)
                    score = 0.0
        return out

    def base(self) -> np.ndarray:
        """Log10 probabilities of the tokens by the arcs of the empty state."""
        return np.log10(self.p1)[self.at[0]]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row
    for each input row; the texts that aren't held out are learned from."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), (crc_mod(id_col, folds) != held_out).alias("train"))
    blocks = materialise(_blocks(docs), "blocks")
    size, starts = blocks.agg(F.sum(F.length("body")), F.sum(F.size(F.filter("train", lambda x: x)))).first()
    parts = max(16, math.ceil((size or 0) * _ASKED / PARTITION_BYTES))
    answers = materialise(_answer(_ask(blocks, parts), parts), "answers")
    total, kinds = answers.filter("block = -1").agg(F.sum("total"), F.sum("kinds")).first()
    total, kinds, starts = total or 0, kinds or 0, starts or 0
    slices = answers.filter("block <> -1").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "counts"))).alias("slices"))
    n_parts = max(12, math.ceil((size or 0) / (8 << 20)))
    joined = blocks.repartition(n_parts, "block").join(slices.repartition(n_parts, "block"), "block")

    def run(batches):
        for b in batches:
            for ids, train, off, body, own in zip(*(b.column(i) for i in range(5))):
                off, data = _read(off.as_py(), body.as_py())
                n = len(off) - 1
                tok, row, keys, at = _questions(off, data)
                parts_of = [_unpacked(s["counts"], np.uint64) for s in own.as_py()]
                counts = [np.concatenate([p[order] for p in parts_of]).astype(np.int64) + c for order, c in enumerate(_learned(train.as_py(), row, keys, at))]
                model = Automaton(tok, row, at, counts, total, kinds, starts)
                known = np.bincount(row, counts[0][at[0]] > 0, n).astype(np.int64)
                cols = [pa.array(ids.as_py(), pa.int64()), pa.array([not t for t in train.as_py()]), pa.array(np.bincount(row, minlength=n)), pa.array(known), pa.array(np.full(n, total, np.int64))]
                cols += [pa.array(np.bincount(row, model.base(), n)), pa.array(model.read(), pa.float64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return joined.select("ids", "train", "off", "body", "slices").mapInArrow(run, schema)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
