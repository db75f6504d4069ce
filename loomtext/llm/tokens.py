"""Operator 5: token counts with a digest cache.

A text's digest and the tokenizer's digest (file, library and its version) are
joined to stored counts; each distinct text that the cache lacks is encoded once,
and its count is appended to the cache. The cache is a Parquet folder with a
partition for each tokenizer digest; counts read it back by digest. The content
is normalised to nothing but null = empty, as counts are of whole texts.

Byte-level files count by pieces (``pretoken``); texts with a special string or
an odd character, and all other tokenizers, go through the library as a whole.

Defined results: null and empty texts have no tokens; rows that repeat come out
as often; a count that two writers append twice is read once; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import bitmap, digest, materialise, picked, run_dir, spread_join
from loomtext.llm.pretoken import PieceTable, pieces, runs

LIMIT = 512


def tokenizer_digest(path: str) -> str:
    """Of the vocabulary file and of the library that reads it."""
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(lib.encode() + b"\0" + f.read()).hexdigest()


@functools.cache
def counter(path: str):
    """A function from texts to their token counts."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(model.encode(t)) for t in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    whole = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    cut = made["pre_tokenizer"] or {}
    if made["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
        return lambda texts: [n for run in runs(texts) for n in whole(run)]
    special = [t["content"] for t in made["added_tokens"]]
    table = PieceTable(lambda p: tok.encode_batch(p, add_special_tokens=False), lambda e: len(e.ids))

    def count(texts):
        out = []
        for run in runs(texts):
            cut = [None if any(s in t for s in special) else pieces(t) for t in run]
            table.learn([c for c in cut if c is not None])
            out += [whole([t])[0] if c is None else sum(map(table.__getitem__, c)) for t, c in zip(run, cut)]
        return out

    return count


def stored(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame | None:
    """(digest, n_tokens) that the cache has for a tokenizer, each digest once; None
    if it has never seen the tokenizer."""
    try:
        got = spark.read.schema("digest binary, n_tokens long").parquet(f"{cache}/tokenizer={tokenizer}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return got.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, text) of rows whose digest the cache lacks. Digests are compared; of
    texts, only those that a bitmap of the missing digests picks move."""
    absent = materialise(rows.select("digest").distinct().join(known, "digest", "left_anti"), "absent")
    number = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    held = rows.sparkSession.sparkContext.broadcast(bitmap(absent.select(number)))

    def run(batches):
        for b in batches:
            ok = [picked(held.value, int.from_bytes(d[:8]) >> 4) for d in b.column(0).to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    some = rows.select("digest", "text").mapInArrow(run, "digest binary, text string")
    return some.join(absent, "digest", "left_semi")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row for each input row. The cache
    is completed for ``docs`` when this returns."""
    spark, version = docs.sparkSession, tokenizer_digest(path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("digest", digest(F.col("text")))
    known = stored(spark, cache, version)
    misses = rows.select("digest", "text") if known is None else _missing(rows, known)
    misses = misses.groupBy("digest", "text").agg(F.lit(1).alias("one")).select("digest", "text")

    def run(batches):
        count = counter(path)
        for b in batches:
            for part in (b.slice(a, 256) for a in range(0, b.num_rows, 256)):  # few texts as Python objects
                n = pa.array(count(part.column(1).to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n], names=["digest", "n_tokens"])

    misses.mapInArrow(run, "digest binary, n_tokens long").write.mode("append").parquet(f"{cache}/tokenizer={version}")
    slim = rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    copies = slim.groupBy("digest").agg(F.count("*").alias("copies"))
    counts = stored(spark, cache, version).join(copies, "digest")
    out = spread_join(slim, counts, "digest", "copies", F.xxhash64("doc_id"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, so that every run does the whole work."""
    import public_tokenizers

    cache = f"{run_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
