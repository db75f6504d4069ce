"""Operator 4: byte-level BPE encoding and decoding.

The tokenizers library runs over Arrow batches. A rank file is turned into its
model: each byte stands for one printable character (the byte-to-character
mapping), and for each token all pairs of tokens that make it up become merges,
in the order of ranks, which is the order in which a rank-driven encoder merges.
Pieces of the pattern are encoded once a worker (``pretoken``). Decoding looks
ids up in the byte table; characters split over tokens come together again, as
bytes are joined before anything is read as UTF-8.

Defined results: null and empty texts have no tokens; ids that a rank file lacks
can't be decoded (KeyError); rows that repeat come out as often; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.pretoken import PieceTable, pieces, runs

#: The rank file of the query; its place is a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def default_path(name: str = RANKS) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """A printable character for each byte: the byte's own where it is printable,
    else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class ByteBpe:
    """A rank file as a model of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.ranks.items()}
        shown = byte_characters()
        vocab = {"".join(shown[b] for b in t): r for t, r in self.ranks.items()}
        merges = []
        for token in sorted(vocab, key=vocab.get):
            merges += [(token[:i], token[i:]) for i in range(1, len(token)) if token[:i] in vocab and token[i:] in vocab]
        model = models.BPE(vocab=vocab, merges=merges, ignore_merges=True)
        self.whole, self.single = Tokenizer(model), Tokenizer(model)
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.whole.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(PATTERN), "isolated"), as_bytes])
        self.single.pre_tokenizer = as_bytes
        encode = functools.partial(self.single.encode_batch, add_special_tokens=False)
        self.table = PieceTable(encode, lambda e: np.array(e.ids, "<u4").tobytes())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of whole texts as little-endian unsigned 32-bit integers."""
        out = []
        for run in runs(texts):
            cut = [pieces(t) for t in run]
            self.table.learn([c for c in cut if c is not None])
            for text, c in zip(run, cut):
                if c is None:
                    out.append(np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
                else:
                    out.append(b"".join(map(self.table.__getitem__, c)))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The table's bytes, joined; an id that it lacks gives those of U+FFFD."""
        return b"".join([self.bytes_of.get(i, b"\xef\xbf\xbd") for i in np.frombuffer(ids, "<u4").tolist()])

    def offsets(self, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The characters (start, end) that each token touches; tokens that share
        a split character overlap in it."""
        parts = [self.bytes_of.get(i, b"\xef\xbf\xbd") for i in np.frombuffer(ids, "<u4").tolist()]
        ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
        heads = np.frombuffer(b"".join(parts), np.uint8) & 0xC0 != 0x80
        char = np.cumsum(heads) - 1
        if not len(ends):
            return ends, ends
        return char[np.r_[0, ends[:-1]]], char[ends - 1] + 1


@functools.cache
def _model(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit integers) and, if asked
    for, starts and ends: the characters that each token touches."""

    def run(batches):
        m = _model(path)
        for b in batches:
            ids = m.encode([t or "" for t in b.column(1).to_pylist()])
            out = [b.column(0), pa.array(ids, pa.binary())]
            if offsets:
                at = [m.offsets(i) for i in ids]
                out += [pa.array([a.astype(np.int32).tolist() for a in x], pa.list_(pa.int32())) for x in (zip(*at) if at else ((), ()))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "ids", "starts", "ends"][: len(out)])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, ids binary" + ", starts array<int>, ends array<int>" * offsets)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, bytes) of (doc_id, ids): the table's bytes of the ids, joined."""

    def run(batches):
        m = _model(path)
        for b in batches:
            out = pa.array([m.decode(i.as_py()) for i in b.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), out], names=["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), a row for each input row. Both
    ways in one worker, so that a task holds the model once, and a few texts at once."""

    def run(batches):
        m = _model(path)
        for whole in batches:
            for b in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                ids = m.encode([t or "" for t in b.column(1).to_pylist()])
                cols = [b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64())]
                cols += [pa.array([hashlib.sha256(x).hexdigest() for x in both], pa.string()) for both in (ids, map(m.decode, ids))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_path())
