"""Operator 6: substring dedup over the whole corpus with enhanced suffix arrays.

A byte goes if it lies in a string of WIDTH bytes that starts somewhere else too.
The windows of WIDTH bytes are dealt out by their minimiser, the least hash of
the GRAM-byte strings inside: equal windows have equal minimisers. Windows in a
row with the same one form a run, a piece of text of at most 2*WIDTH-GRAM bytes.

1. Distinct texts are packed into blocks (copies of a text are all repeat).
2. Each block asks, for its runs, by (minimiser, content hash). A partition of the
   hash space adds up all blocks' questions and answers in their order: a run that
   occurs twice repeats as a whole; a minimiser that only one run has repeats
   nothing; what is left are different runs with one minimiser. Of these one
   block each is asked to hand in the bytes.
3. Runs handed in meet by minimiser. A suffix array with its longest common
   prefixes is built over a bounded batch of groups, a stack scan walks the tree of
   common-prefix intervals, and intervals of WIDTH bytes or more whose
   occurrences are preceded by different bytes (or a run's start) are maximal repeats;
   they come out with all their occurrences.
4. Answers and repeats return to their blocks, which cut the bytes out.

A minimiser with over HOT different runs is never brought together: blocks ask for
the windows of its runs one by one, by 128-bit hashes and each once a block, as they
asked for runs.

Runs and windows are equal if 128 bits of hash are. Work is linear in the text;
no group is ever in one task, and common passages cost one question a block.

Defined results: null counts as empty; rows that repeat a text are copies of each
other, so of WIDTH bytes or more nothing stays; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import CHUNK_BYTES, digest, discard, materialise, spread_join, text_chunks

WIDTH = 200
GRAM = 64
HOT = 512
BLOCK_BYTES = CHUNK_BYTES // 2
#: Bytes of a text that are hashed at once.
SECTION = 1 << 22
#: Bytes of runs in a suffix array.
BATCH_BYTES = 1 << 19
PARTITION_BYTES = 64 << 20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_AT = np.uint64((1 << 28) - 1)
#: Answers: the run occurs twice; hand it in; ask for its windows; no other run has its
#: minimiser.
TWICE, SEND, SPLIT, ALONE = 1, 2, 4, 8


def _powers(base: int, n: int, held={}) -> np.ndarray:  # noqa: B006
    if base not in held or len(held[base]) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        held[base] = np.multiply.accumulate(p)
    return held[base][:n]


def _mix(h):
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    n = len(x) - width + 1
    pad = np.full(-len(x) % width, np.uint64(0xFFFFFFFFFFFFFFFF))
    cut = np.concatenate([x, pad]).reshape(-1, width)
    ahead = np.minimum.accumulate(cut, axis=1).ravel()
    behind = np.minimum.accumulate(cut[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


class Runs(NamedTuple):
    first: np.ndarray  # first window of a run
    many: np.ndarray  # its windows
    key: np.ndarray  # minimiser
    hash: np.ndarray  # of the run's bytes


def runs_of(off: np.ndarray, data: np.ndarray, width: int, gram: int, section: int = SECTION) -> Runs:
    """The runs of a block, section by section: a long text takes no more memory."""
    found = [_runs(off, data, a, width, gram, section) for a in range(0, max(1, len(data) - width + 1), section)]
    return Runs(*map(np.concatenate, zip(*found)))


def _runs(off: np.ndarray, data: np.ndarray, a: int, width: int, gram: int, section: int) -> Runs:
    """Those that start in a section from byte ``a`` on."""
    data = data[a : a + section + width - 1]
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return Runs(none, none, none.astype(np.uint64), none.astype(np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)))])
    h = _mix((total[gram:] - total[:-gram]) * _powers(_INVERSE, len(data) + 1)[: len(data) - gram + 1])
    del total
    pick = _least((h & ~_AT) | np.arange(len(h), dtype=np.uint64), width - gram + 1) & _AT
    end = np.repeat(off[1:], np.diff(np.clip(off, a, a + len(pick)))) - a
    inside = np.flatnonzero(np.arange(len(pick)) + width <= end)
    pick = pick[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (np.diff(inside) != 1)
    at = np.flatnonzero(new)
    first, many = inside[at], np.diff(np.r_[at, len(inside)])
    raw, hash_of = data.tobytes(), xxhash.xxh3_64_intdigest
    content = np.fromiter((hash_of(raw[x:y]) for x, y in zip(first.tolist(), (first + many + width - 1).tolist())), np.uint64, len(first))
    # least hashes are small: mixed again, they are dealt evenly
    return Runs(first + a, many, _mix(h[pick[at].astype(np.int64)] + np.uint64(_BASE)), content)


def _distinct(key: np.ndarray, hash_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(one place for each key and hash, in order; which of them each is)."""
    order = np.lexsort((hash_, key))
    k, h = key[order], hash_[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (h[1:] != h[:-1])
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[new], of


def _blocks(texts: DataFrame) -> DataFrame:
    """(block, digests, copies, off, body) of (digest, text, copies)."""

    def run(batches):
        seen = 0
        for b in batches:
            for first, off, data in text_chunks(b.column(1), BLOCK_BYTES):
                n = len(off) - 1
                cols = [pa.array([seen]), pa.array([b.column(0).slice(first, n).to_pylist()], pa.list_(pa.binary())), pa.array([b.column(2).slice(first, n).to_pylist()], pa.list_(pa.int64()))]
                cols += [pa.array([off.tobytes()], pa.binary()), pa.array([zstandard.compress(data.tobytes(), 1)], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["seq", "digests", "copies", "off", "body"])
                seen += 1

    packed = texts.mapInArrow(run, "seq long, digests array<binary>, copies array<long>, off binary, body binary")
    return packed.select((F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("seq")).alias("block"), "digests", "copies", "off", "body")


def _read(off, body):
    return np.frombuffer(off, np.int64), np.frombuffer(zstandard.decompress(body), np.uint8)


def _pack(x: np.ndarray) -> bytes:
    width = x.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _edges(parts: int) -> np.ndarray:
    step = (1 << 64) // parts
    return np.array([i * step for i in range(1, parts)], np.uint64)


_QUESTION = "part int, block long, keys binary, hashes binary, many binary"


def _slices(block: int, key: np.ndarray, hash_: np.ndarray, many: np.ndarray, parts: int) -> pa.RecordBatch:
    """A block's questions, in order of (key, hash), cut by partition; none is empty."""
    cut = np.r_[0, np.searchsorted(key, _edges(parts)), len(key)]
    own = [(p, cut[p], cut[p + 1]) for p in range(parts) if cut[p + 1] > cut[p]]
    cols = [pa.array([p for p, _, _ in own], pa.int32()), pa.array([block] * len(own), pa.int64())]
    cols += [pa.array([_pack(np.diff(key[a:z], prepend=np.uint64(0))) for _, a, z in own], pa.binary())]
    cols += [pa.array([_pack(x[a:z]) for _, a, z in own], pa.binary()) for x in (hash_, many)]
    return pa.RecordBatch.from_arrays(cols, names=["part", "block", "keys", "hashes", "many"])


def _ask(blocks: DataFrame, parts: int, width: int, gram: int) -> DataFrame:
    """Each block's distinct runs, and whether it has one (1) or more of each (2)."""

    def run(batches):
        for b in batches:
            for block, off, body in zip(*(b.column(i) for i in range(3))):
                runs = runs_of(*_read(off.as_py(), body.as_py()), width, gram)
                one, of = _distinct(runs.key, runs.hash)
                many = np.minimum(2, np.bincount(of, minlength=len(one))).astype(np.uint8)
                yield _slices(block.as_py(), runs.key[one], runs.hash[one], many, parts)

    return blocks.select("block", "off", "body").mapInArrow(run, _QUESTION)


def _answer(asked: DataFrame, parts: int, hot: int) -> DataFrame:
    """(block, part, flags): an answer to each question, in its order. A task has one
    partition's questions, of bounded size."""

    def solve(rows: list) -> pa.RecordBatch:
        key = [np.cumsum(_unpack(r[2], np.uint64), dtype=np.uint64) for r in rows]
        cut = np.r_[0, np.cumsum([len(k) for k in key])]
        key = np.concatenate(key)
        hash_ = np.concatenate([_unpack(r[3], np.uint64) for r in rows])
        many = np.concatenate([_unpack(r[4], np.uint8) for r in rows]).astype(np.int64)
        order = np.lexsort((hash_, key))
        k, h = key[order], hash_[order]
        new_key = np.ones(len(k), bool)
        new_key[1:] = k[1:] != k[:-1]
        new = new_key.copy()
        new[1:] |= h[1:] != h[:-1]
        run_of, key_of = np.cumsum(new) - 1, np.cumsum(new_key) - 1
        twice = (np.bincount(run_of, many[order]) > 1)[run_of]
        kinds = np.bincount(key_of, new)[key_of]
        flags = np.zeros(len(k), np.uint8)
        flags[order] = twice * TWICE + (new & (kinds > 1)) * np.where(kinds > hot, SPLIT, SEND) + (kinds == 1) * ALONE
        cols = [pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([zstandard.compress(flags[a:z].tobytes(), 1) for a, z in zip(cut[:-1], cut[1:])], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["block", "part", "flags"])

    def run(batches):
        rows = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if rows and rows[0][0] != row[0]:
                    yield solve(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield solve(rows)

    dealt = asked.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    return dealt.mapInArrow(run, "block long, part int, flags binary")


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    return answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "flags"))).alias(name))


def _joined(slices) -> np.ndarray:
    """A block's answers, of all partitions, in the order of its questions."""
    return np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(zstandard.decompress(s["flags"]), np.uint8) for s in slices or ())])


def _flags(off, body, slices, width, gram):
    """A block's runs, which distinct run each is, and the answers to those."""
    off, data = _read(off, body)
    runs = runs_of(off, data, width, gram)
    one, of = _distinct(runs.key, runs.hash)
    return off, data, runs, one, of, _joined(slices)


class Windows(NamedTuple):
    place: np.ndarray  # of each window
    of: np.ndarray  # which question it is
    key: np.ndarray
    hash: np.ndarray
    many: np.ndarray


def _windows(raw: bytes, runs: Runs, one: np.ndarray, flags: np.ndarray, width: int) -> Windows:
    """The windows of runs whose minimiser has too many others: a question each for the
    different ones, by 128 bits of hash. Those of a run that repeats count twice."""
    places, twice = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    for i in np.flatnonzero(flags & SPLIT):
        n = int(runs.many[one[i]])
        places.append(np.arange(n) + runs.first[one[i]])
        twice.append(np.full(n, bool(flags[i] & TWICE)))
    place, twice = np.concatenate(places), np.concatenate(twice)
    digest_of = xxhash.xxh3_128_digest
    d = np.frombuffer(b"".join(digest_of(raw[w : w + width]) for w in place.tolist()), np.uint64).reshape(-1, 2)
    key, hash_ = d[:, 0].copy(), d[:, 1].copy()
    first, of = _distinct(key, hash_)
    many = np.minimum(2, np.bincount(of, 1 + twice, len(first))).astype(np.uint8)
    return Windows(place, of, key[first], hash_[first], many)


def _ask_windows(told: DataFrame, parts: int, width: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for block, off, body, slices in zip(*(b.column(i) for i in range(4))):
                if (_joined(slices.as_py()) & SPLIT).any():
                    _, data, runs, one, _, flags = _flags(off.as_py(), body.as_py(), slices.as_py(), width, gram)
                    w = _windows(data.tobytes(), runs, one, flags, width)
                    yield _slices(block.as_py(), w.key, w.hash, w.many, parts)

    return told.select("block", "off", "body", "slices").mapInArrow(run, _QUESTION)


def _signed(x) -> pa.Array:
    return pa.array(np.array(x, np.uint64).view(np.int64))


def _hand_in(told: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, hash, block, at, body): runs handed in. ``block`` is -1 where the whole run
    is known to repeat."""

    def run(batches):
        for b in batches:
            for block, off, body, slices in zip(*(b.column(i) for i in range(4))):
                _, data, runs, one, _, flags = _flags(off.as_py(), body.as_py(), slices.as_py(), width, gram)
                raw, out = data.tobytes(), []
                for i in np.flatnonzero(flags & SEND).tolist():
                    r = one[i]
                    a, n = int(runs.first[r]), int(runs.many[r])
                    out.append((int(runs.key[r]), int(runs.hash[r]), -1 if flags[i] & TWICE else block.as_py(), a, raw[a : a + n + width - 1]))
                for z in range(0, len(out), 4096):
                    key, hash_, own, at, body_ = zip(*out[z : z + 4096])
                    cols = [*map(_signed, (key, hash_)), pa.array(own, pa.int64()), pa.array(at, pa.int64()), pa.array(body_, pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, names=["key", "hash", "block", "at", "body"])

    return told.select("block", "off", "body", "slices").mapInArrow(run, "key long, hash long, block long, at long, body binary")


def suffix_array(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, common prefix with the one before, bytes, string starts) of the
    strings side by side, each ended by a separator that equals nothing."""
    size = np.array([len(s) for s in strings], np.int64)
    start = np.r_[0, np.cumsum(size + 1)[:-1]]
    data = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64)
    data[start + size] = 256 + np.arange(len(strings))
    n, longest = len(data), int(size.max())
    ranks, step, rank = [], 1, data
    while True:
        ranks.append(rank.astype(np.int32))
        if step > longest:
            break
        ahead = np.zeros(n, np.int64)
        ahead[:-step] = rank[step:] + 1
        order = np.argsort(joint := rank * (n + 512) + ahead, kind="stable")
        new = np.zeros(n, np.int64)
        new[order[1:]] = np.cumsum(joint[order[1:]] != joint[order[:-1]])
        rank, step = new, step * 2
    sa = np.argsort(rank, kind="stable")
    a, b, lcp = sa[1:].copy(), sa[:-1].copy(), np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        ok = (a < n) & (b < n)
        same = ok.copy()
        same[ok] = ranks[level][a[ok]] == ranks[level][b[ok]]
        step = np.where(same, 1 << level, 0)
        lcp, a, b = lcp + step, a + step, b + step
    return sa, np.r_[0, lcp], data, start


def maximal_repeats(sa, lcp, before, least: int):
    """(length, lo, hi): common-prefix intervals sa[lo..hi] of ``least`` bytes or more
    whose occurrences differ in the byte before. ``before``: that byte by place in
    the array, -2 where there is none (different from all)."""
    deep = np.flatnonzero(lcp >= least)
    if not len(deep):
        return
    values, left = lcp.tolist(), before.tolist()
    gap = np.flatnonzero(np.diff(deep) > 1)
    for lo, hi in zip(deep[np.r_[0, gap + 1]].tolist(), deep[np.r_[gap, len(deep) - 1]].tolist()):
        stack = []  # (length, first place, byte before all so far or -2)
        for i in range(lo, hi + 2):
            now = values[i] if i <= hi else 0
            first, mark = i - 1, left[i - 1]
            while stack and stack[-1][0] > now:
                length, first, own = stack.pop()
                mark = own if own == mark else -2
                if mark == -2:
                    yield length, first, i - 1
            if stack and stack[-1][0] == now:
                length, place, own = stack.pop()
                stack.append((length, place, own if own == mark else -2))
            elif i <= hi:
                stack.append((now, first, mark))


def repeat_groups(strings: list[bytes], width: int = WIDTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """The maximal repeats among ``strings``: (length, occurrences as (string,
    place)), all of them."""
    sa, lcp, data, start = suffix_array(strings)
    before = np.where(np.isin(sa, start), -2, data[sa - 1])
    out = []
    for length, lo, hi in maximal_repeats(sa, lcp, before, width):
        at = np.sort(sa[lo : hi + 1])
        of = np.searchsorted(start, at, side="right") - 1
        out.append((length, list(zip(of.tolist(), (at - start[of]).tolist()))))
    return out


def _repeated(strings: list[bytes], width: int) -> list[np.ndarray]:
    """For each string which of its windows occur twice."""
    sa, lcp, data, start = suffix_array(strings)
    before = np.where(np.isin(sa, start), -2, data[sa - 1])
    best = np.zeros(len(sa), np.int64)
    for length, lo, hi in maximal_repeats(sa, lcp, before, width):
        best[lo : hi + 1] = np.maximum(best[lo : hi + 1], length)
    mark = np.zeros(len(sa) + 1, np.int64)
    own = np.flatnonzero(best)
    np.add.at(mark, sa[own], 1)
    np.add.at(mark, np.minimum(sa[own] + best[own] - width + 1, len(sa)), -1)
    hit = np.cumsum(mark[:-1]) > 0
    return [hit[a : a + len(s) - width + 1] for a, s in zip(start.tolist(), strings)]


def _batches(batches, size: int):
    """Whole groups of runs with one minimiser, of about ``size`` bytes together."""
    held = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        key = t["key"].to_numpy()
        bytes_ = np.array([len(x) for x in t["body"].to_pylist()])
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends, a = np.cumsum(bytes_), 0
        for i in range(1, len(new)):
            if ends[new[i] - 1] - (ends[a - 1] if a else 0) >= size:
                yield t.slice(a, new[i] - a)
                a = int(new[i])
        held = t.slice(a)
    if held is not None and held.num_rows:
        yield held


def _meet(sent: DataFrame, width: int, batch: int, parts: int) -> DataFrame:
    """(block, first, many): windows of runs handed in that lie in a maximal repeat."""

    def run(batches):
        for t in _batches(batches, batch):
            block, at, body = (t[c].to_pylist() for c in ("block", "at", "body"))
            out = []
            for i, hit in enumerate(_repeated(body, width)):
                if block[i] >= 0 and hit.any():
                    edge = np.flatnonzero(np.diff(np.r_[False, hit, False]))
                    out += [(block[i], at[i] + int(x), int(y - x)) for x, y in zip(edge[::2], edge[1::2])]
            if out:
                own, first, n = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(first, pa.int64()), pa.array(n, pa.int32())], names=["block", "first", "many"])

    dealt = sent.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "block long, first long, many int")


_GROUP = "group long, length int, key long, hash long, skip int"


def _group_batch(rows) -> pa.RecordBatch:
    group, length, key, hash_, skip = zip(*rows) if rows else ((), (), (), (), ())
    cols = [_signed(group), pa.array(length, pa.int32()), _signed(key), _signed(hash_), pa.array(skip, pa.int32())]
    return pa.RecordBatch.from_arrays(cols, names=["group", "length", "key", "hash", "skip"])


def _intervals(sent: DataFrame, width: int, batch: int, parts: int) -> DataFrame:
    """Every maximal repeat among runs of one minimiser, with all its occurrences in them:
    the intervals of the tree whose left extensions differ."""

    def run(batches):
        for t in _batches(batches, batch):
            key, hash_ = (t[c].to_numpy().view(np.uint64).tolist() for c in ("key", "hash"))
            body, out = t["body"].to_pylist(), []
            for length, places in repeat_groups(body, width):
                i, at = places[0]
                group = xxhash.xxh3_64_intdigest(body[i][at : at + length])
                out += [(group, length, key[j], hash_[j], p) for j, p in places]
            yield _group_batch(out)

    return sent.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, _GROUP)


def _whole(told: DataFrame, width: int, gram: int) -> DataFrame:
    """Runs that repeat as a whole, and repeated windows of hot minimisers' runs."""

    def run(batches):
        for b in batches:
            for off, body, slices, windows in zip(*(b.column(i) for i in range(4))):
                _, data, runs, one, _, flags = _flags(off.as_py(), body.as_py(), slices.as_py(), width, gram)
                raw, hash_of, out = data.tobytes(), xxhash.xxh3_64_intdigest, []
                for i in np.flatnonzero((flags & TWICE > 0) & (flags & (SEND | ALONE) > 0)):
                    a, n = int(runs.first[one[i]]), int(runs.many[one[i]]) + width - 1
                    out.append((hash_of(raw[a : a + n]), n, int(runs.key[one[i]]), int(runs.hash[one[i]]), 0))
                if (flags & SPLIT).any():
                    w = _windows(raw, runs, one, flags, width)
                    hit = (_joined(windows.as_py()) & TWICE > 0)[w.of]
                    run_of = np.searchsorted(runs.first, w.place, side="right") - 1
                    out += [(hash_of(raw[p : p + width]), width, int(runs.key[r]), int(runs.hash[r]), p - int(runs.first[r])) for p, r in zip(w.place[hit].tolist(), run_of[hit])]
                yield _group_batch(out)

    return told.select("off", "body", "slices", "windows").mapInArrow(run, _GROUP)


def _members(told: DataFrame, width: int, gram: int) -> DataFrame:
    """(key, hash, digest, start): all runs that may hold a repeat, by text and byte."""

    def run(batches):
        for b in batches:
            for digests, off, body, slices in zip(*(b.column(i) for i in range(4))):
                off, _, runs, _, of, flags = _flags(off.as_py(), body.as_py(), slices.as_py(), width, gram)
                some = flags[of] & (TWICE | SEND | SPLIT) > 0
                text = np.searchsorted(off, runs.first[some], side="right") - 1
                own = digests.as_py()
                cols = [*map(_signed, (runs.key[some], runs.hash[some])), pa.array([own[i] for i in text], pa.binary()), pa.array(runs.first[some] - off[text], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "hash", "digest", "start"])

    return told.select("digests", "off", "body", "slices").mapInArrow(run, "key long, hash long, digest binary, start long")


def _cut(joined: DataFrame, width: int, gram: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for digests, copies, off, body, slices, windows, found in zip(*(b.column(i) for i in range(7))):
                off, data, runs, one, of, flags = _flags(off.as_py(), body.as_py(), slices.as_py(), width, gram)
                whole = (flags[of] & TWICE) > 0
                first, many = [runs.first[whole]], [runs.many[whole]]
                if (flags & SPLIT).any():
                    w = _windows(data.tobytes(), runs, one, flags, width)
                    first.append(w.place[(_joined(windows.as_py()) & TWICE > 0)[w.of]])
                    many.append(np.ones(len(first[-1]), np.int64))
                first.append(np.array([x["first"] for x in found.as_py() or ()], np.int64))
                many.append(np.array([x["many"] for x in found.as_py() or ()], np.int64))
                first, many = np.concatenate(first), np.concatenate(many)
                mark = np.zeros(len(data) + 1, np.int64)
                np.add.at(mark, first, 1)
                np.add.at(mark, first + many + width - 1, -1)
                gone, out = np.cumsum(mark[:-1]) > 0, []
                for i, (d, n) in enumerate(zip(digests.as_py(), copies.as_py())):
                    own, text = gone[off[i] : off[i + 1]], data[off[i] : off[i + 1]]
                    if n > 1 and len(own) >= width:
                        own = np.ones(len(own), bool)
                    spans = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
                    out.append((d, n, len(own), int(own.sum()), spans, hashlib.sha256(text[~own].tobytes()).hexdigest()))
                names = ["digest", "copies", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                kinds = [pa.binary(), *[pa.int64()] * 4, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names=names)

    schema = "digest binary, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return joined.select("digests", "copies", "off", "body", "slices", "windows", "found").mapInArrow(run, schema)


class _Told(NamedTuple):
    """Blocks with the answers to their questions, and where they are dealt to."""

    rows: DataFrame
    told: DataFrame
    windows: DataFrame
    n: int


def _tell(docs: DataFrame, id_col: str, text_col: str, width: int, gram: int, hot: int) -> _Told:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    texts = rows.withColumn("digest", digest(F.col("text"))).groupBy("digest", "text").agg(F.count("*").alias("copies"))
    blocks = materialise(_blocks(texts.select("digest", "text", "copies")), "blocks")
    size = blocks.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(16, math.ceil(size / PARTITION_BYTES * 4))
    n = max(12, math.ceil(size / (8 << 20)))
    answers = materialise(_answer(_ask(blocks, parts, width, gram), parts, hot), "answers")
    told = blocks.repartition(n, "block").join(_by_block(answers, "slices").repartition(n, "block"), "block", "left")
    told = materialise(told, "told")
    discard(blocks, answers)
    return _Told(rows, told, materialise(_answer(_ask_windows(told, parts, width, gram), parts, 1), "windows"), n)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256), a row for each input row."""
    rows, told, windows, n = _tell(docs, id_col, text_col, width, gram, hot)
    found = materialise(_meet(_hand_in(told, width, gram), width, batch, n), "found")
    found_by = found.groupBy("block").agg(F.collect_list(F.struct("first", "many")).alias("found"))
    more = _by_block(windows, "windows").join(found_by, "block", "full")
    result = materialise(_cut(told.repartition(n, "block").join(more.repartition(n, "block"), "block", "left"), width, gram), "kept")
    discard(told, windows, found)
    slim = rows.select("doc_id", digest(F.col("text")).alias("digest"))
    out = spread_join(slim, result, "digest", "copies", F.xxhash64("doc_id"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def corpus_groups(docs: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM, hot: int = HOT, batch: int = BATCH_BYTES) -> DataFrame:
    """(group, length, digest, start): the repeats that ``remove_repeats`` removes, each
    with all its occurrences: the text's SHA-256 and the byte where it starts. Repeats are
    maximal within runs (of 2*WIDTH-GRAM bytes at most); a longer one is several groups.
    Groups hold runs by their hash, and meet the runs' places at the end."""
    _, told, windows, n = _tell(docs.withColumn("__id", F.lit(None).cast("long")), "__id", text_col, width, gram, hot)
    heard = told.repartition(n, "block").join(_by_block(windows, "windows").repartition(n, "block"), "block", "left")
    groups = _intervals(_hand_in(told, width, gram), width, batch, n).union(_whole(heard, width, gram)).distinct()
    out = groups.join(_members(told, width, gram), ["key", "hash"])
    return out.select("group", "length", "digest", (F.col("start") + F.col("skip")).alias("start")).distinct()


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
