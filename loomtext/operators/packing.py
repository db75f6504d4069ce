"""Token sequences for training (K9-K12) and seeded splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.operators import selection


def pad(ids: Column, length: int, value: int, left: bool = False) -> Column:
    """``ids`` filled up to ``length``."""
    fill = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(ids), F.lit(0)))
    return F.concat(fill, ids) if left else F.concat(ids, fill)


def pack(docs: DataFrame, length: int, stride: int | None = None, pad_id: int = 0, inclusive: bool = False, least: float | None = None) -> DataFrame:
    """(doc_id, seq_no, ids) of (doc_id, ids). Longer texts give windows at every
    ``stride``, without their tail; by default the last start is excluded, so that
    exactly ``length`` tokens give none (K9; ``inclusive`` for the variants of K10).
    Shorter ones of over ``least`` tokens are padded."""
    stride = stride or length // 2
    least = length / 20 + 3 if least is None else least
    n = F.size("ids")
    last = n - length - (0 if inclusive else 1)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.slice("ids", i + 1, length))
    whole = F.when((n > least) & (n < length), F.array(pad(F.col("ids"), length, pad_id)))
    return docs.select("doc_id", F.posexplode(F.coalesce(whole, windows)).alias("seq_no", "ids"))


def shifted(ids: Column, pad_id: int = 0) -> Column:
    """struct<x, y, mask>: inputs, next tokens and which inputs aren't padding."""
    x, y = F.slice(ids, F.lit(1), F.size(ids) - 1), F.slice(ids, F.lit(2), F.size(ids) - 1)
    return F.struct(x.alias("x"), y.alias("y"), F.transform(x, lambda t: t != pad_id).alias("mask"))


def split(docs: DataFrame, share: float, seed: int, key: str = "doc_id") -> DataFrame:
    """``docs`` with ``train``: true for exactly int(n * share) rows, the first of a seeded
    shuffle of the keys (I5)."""
    return docs.withColumn("train", selection.among_first(docs, seed, key, share=share))


def batches(seqs: DataFrame, size: int, pad_id: int = 0) -> DataFrame:
    """Sequences (seq_no, ids) in batches of ``size``, padded to their batch's longest
    (K12). Numbers are dense, so a batch is their quotient."""
    b = seqs.withColumn("batch", F.floor(F.col("seq_no") / size))
    w = Window.partitionBy("batch")
    longest = F.max(F.size("ids")).over(w)
    return b.withColumn("longest", longest).select("batch", "seq_no", F.concat("ids", F.array_repeat(F.lit(pad_id), F.col("longest") - F.size("ids"))).alias("ids"))
