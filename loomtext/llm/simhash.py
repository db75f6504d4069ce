"""Operator 1: SimHash near-duplicates, candidates by pigeonring filtering.

A 64-bit fingerprint is cut into a ring of four 16-bit segments. If two
fingerprints differ in at most 3 bits, some segment starts a chain in which the
first j segments together differ in at most 3*j/4 bits, for each j: 0, 1, 2, 3.
Candidates share the start segment, and all but one of the parts of the next segment
(at most one bit differs there): with halves, 24 bits of key and 8 rows a fingerprint;
over 2^26 distinct fingerprints quarters, 28 bits and 16 rows, over 2^30 eighths. A candidate passes the rest of the chain, then the full Hamming
distance.

Only distinct fingerprints are compared, so exact copies cost nothing. A bucket
of over BLOCK fingerprints is dealt to tasks as pairs of blocks, and each block
pair returns a spanning forest of its links, never all pairs; components need
no more.

Defined results: a null or blank text has fingerprint zero and links like any
other; rows that repeat a doc_id come out as often as they came in; a null
doc_id gets the smallest non-null doc_id of its component (null if there is
none); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtext.llm.common import LOWER, components, discard, materialise, spread_join

SEED = 42
SHINGLE = 3
SEGMENTS = 4
SEGMENT_BITS = 16
BUDGET = 3
#: Fingerprints of a bucket that are compared at once.
BLOCK = 2048
_SLICE = 1 << 15


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The signed 64-bit SimHash of a whole text."""
    got = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not got:
        return 0
    if len(got) < words:
        shingles, total = [b" ".join(got)], 1
    else:
        total = len(got) - words + 1
        shingles = None
    hash_of, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, total, _SLICE):
        part = shingles or [b" ".join(q) for q in zip(*(got[a + i : min(a + _SLICE, total) + i] for i in range(words)))]
        h = np.fromiter((hash_of(s, seed) for s in part), np.uint64, len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp long), a row for each input row."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(1)), np.int64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, fp long")


def _halves(distinct: int) -> int:
    """Into how many parts the chain's second segment is cut: more fingerprints get
    longer keys, so that buckets stay small."""
    return 2 if distinct <= 1 << 26 else 4 if distinct <= 1 << 30 else 8


def chain_keys(fp: str = "fp", parts: int = 2):
    """The bucket keys of a fingerprint: chain start, its segment, and all but one of
    the parts of the next segment (at most one bit differs there)."""
    keys, width = [], SEGMENT_BITS // parts
    for i in range(SEGMENTS):
        seg = F.shiftrightunsigned(F.col(fp), SEGMENT_BITS * i).bitwiseAND(0xFFFF)
        nxt = F.shiftrightunsigned(F.col(fp), SEGMENT_BITS * ((i + 1) % SEGMENTS)).bitwiseAND(0xFFFF)
        for j in range(parts):
            above, below = F.shiftrightunsigned(nxt, width * (j + 1)), nxt.bitwiseAND((1 << width * j) - 1)
            rest = above * (1 << width * j) + below
            keys.append(F.lit((i * parts + j) << (32 - width)).cast("long") + seg * (1 << (16 - width)) + rest)
    return F.array(*keys)


def _chain_ok(diff: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Does the chain of ``diff`` (xor of two fingerprints) from ``start`` stay
    within its budgets, the last being the Hamming distance?"""
    ok, spent = np.ones(diff.shape, bool), np.zeros(diff.shape, np.uint8)
    for j in range(SEGMENTS):
        seg = (diff >> np.uint64(SEGMENT_BITS * ((start + j) % SEGMENTS))) & np.uint64(0xFFFF)
        spent += np.bitwise_count(seg)
        ok &= spent <= BUDGET * (j + 1) // SEGMENTS
    return ok


def _forest(fps: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join each fingerprint to the first of its component."""
    n = len(fps)
    label = np.arange(n)
    step = max(1, (1 << 21) // n)
    near = []
    for a in range(0, n, step):
        i, j = np.nonzero(_chain_ok(fps[a : a + step, None] ^ fps[None, :], start))
        keep = i + a < j
        near.append(np.stack([i[keep] + a, j[keep]]))
    i, j = np.concatenate(near, axis=1)
    while len(i):
        low = np.minimum(label[i], label[j])
        up = label.copy()
        np.minimum.at(up, label[i], low)
        np.minimum.at(up, label[j], low)
        while (up != up[up]).any():
            up = up[up]
        label = up[label]
        if (label[i] == label[j]).all():
            break
    own = label != np.arange(n)
    return fps[own].view(np.int64), fps[label[own]].view(np.int64)


def links(distinct: DataFrame, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``distinct`` (fp): enough
    of them to join whatever differs in at most 3 bits, none that doesn't."""
    parts = parts or _halves(distinct.count())
    start_bits = 32 - SEGMENT_BITS // parts
    rows = distinct.select("fp", F.explode(chain_keys("fp", parts)).alias("key"))
    large = rows.groupBy("key").count().filter(F.col("count") > block)
    large = large.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("fp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def run(batches):
        held = None
        for b in batches:
            got = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                got = [np.concatenate(x) for x in zip(held, got)]
            new = np.ones(len(got[0]), bool)
            new[1:] = (got[1][1:] != got[1][:-1]) | (got[2][1:] != got[2][:-1]) | (got[3][1:] != got[3][:-1])
            at = np.flatnonzero(new)
            if not len(at):
                continue
            held = [x[at[-1] :] for x in got]  # the last group may go on in the next batch
            yield from emit([x[: at[-1]] for x in got], at)
        if held is not None and len(held[0]) > 1:
            yield from emit(held, np.array([0, len(held[0])]))

    def emit(got, at):
        size = np.diff(at)
        found = [_forest(got[0][a : a + n].view(np.uint64), int(got[1][a] >> start_bits) // parts) for a, n in zip(at[:-1][size > 1], size[size > 1])]
        if found:
            a, b = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    dealt = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each input row."""
    fps = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    roots = components(links(distinct.select("fp"), block))
    joined = distinct.join(roots, distinct["fp"] == roots["node"], "left")
    joined = joined.select("fp", "least", "copies", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    classes = spread_join(joined.drop("least"), least, "root", "n", F.col("fp"))
    classes = materialise(classes.select("fp", "copies", "component_id"), "classes")
    discard(distinct, roots)
    out = spread_join(fps, classes, "fp", "copies", F.xxhash64("doc_id"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one document of each component: its smallest id.
    Rows without an id stay."""
    ids = near_duplicates(docs, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias("__drop"), F.col("fingerprint").alias("__fp")).distinct()

    def run(batches):
        for b in batches:
            fps = [f"{fingerprint(t) & (1 << 64) - 1:016x}" for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps, pa.string())], names=[*b.schema.names, "__own"])

    at = docs.columns.index(text_col)
    rows = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__own", T.StringType())]))
    same = (F.col(id_col).cast("long") == F.col("__drop")) & (F.col("__own") == F.col("__fp"))
    return rows.join(ids, same, "left_anti").drop("__own")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
