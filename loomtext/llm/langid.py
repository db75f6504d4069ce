"""Operator 2: language ID by language-bitmask n-gram filters.

Each language has a Bloom filter of the byte n-grams that are typical of it. The
filters are kept bit-sliced: slot s holds a word whose bit l is language l's bit
s, so the AND of a few slots returns all languages that contain an n-gram. A
text's n-grams are looked up this way, bits are counted for each language, and
the counts are corrected for the share that false positives are expected to
add; the language with the most wins.

The filters are learned from a sample of about PER_LANGUAGE labelled texts of
each language (whole texts, picked by a hash of doc_id); its bound is a
parameter. Prediction reads the text alone.

Defined results: ``und`` with score 0 for a null text, for one without a letter
and where no label can be learned from; if no n-gram is known, the most frequent
language with score 0; of equal counts the more frequent language wins; rows
that repeat come out as often; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import STEP_BYTES, crc_mod, text_chunks

NGRAM = 4
#: Labelled texts to learn from, about, for each language.
PER_LANGUAGE = 2000
#: An n-gram belongs to a language if it's at least this frequent in it, relative
#: to where it is most frequent, and was seen MIN_COUNT times.
SHARE = 0.5
MIN_COUNT = 3
SLOTS = 1 << 20
HASHES = 2
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

#: Rows of a batch that are worked on at once.
_ROWS = 256

#: Bytes as the n-grams see them: letters in lower case, other ASCII a space.
_FOLD = np.array([c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)], np.uint8)


def _grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram) of every n-gram of a run of texts; spaces count once, and
    each text starts and ends with one."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(off))
    folded = np.empty(len(data) + 2 * n, np.uint8)
    shift = np.arange(len(data)) + 2 * row + 1
    folded.fill(32)
    folded[shift] = _FOLD[data]
    rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(off) + 2)
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] != 32) | (folded[:-1] != 32) | (rows[1:] != rows[:-1])
    folded, rows = folded[keep], rows[keep]
    m = len(folded) - NGRAM + 1
    if m <= 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    gram = np.zeros(m, np.uint64)
    for i in range(NGRAM):
        gram = (gram << np.uint64(8)) | folded[i : i + m]
    inside = rows[:m] == rows[NGRAM - 1 :]
    return rows[:m][inside], gram[inside]


def _small(batches):
    """Batches of few rows: a worker holds several copies of one, and n-grams of its texts."""
    return (b.slice(at, _ROWS) for b in batches for at in range(0, b.num_rows, _ROWS))


def _slots(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    shift = np.uint64(65 - slots.bit_length())
    return [(gram * np.uint64(k)) >> shift for k in _ODD[:HASHES]]


class Filters:
    """Bit-sliced Bloom filters of at most 64 languages a word of ``masks``."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], slots: int = SLOTS):
        self.langs, self.slots = langs, slots
        self.masks = np.zeros(((len(langs) + 63) // 64, slots), np.uint64)
        self.false = np.zeros(len(langs))
        for l, own in enumerate(grams):
            filled = [_slots(own, slots)]
            for at in filled[0]:
                self.masks[l // 64, at] |= np.uint64(1 << (l % 64))
            bit = (self.masks[l // 64] >> np.uint64(l % 64)) & np.uint64(1)
            self.false[l] = (float(bit.sum()) / slots) ** HASHES

    def counts(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a run of texts: corrected counts (text, language), and n-grams."""
        n = len(off) - 1
        row, gram = _grams(off, data)
        total = np.bincount(row, minlength=n).astype(float)
        at = _slots(gram, self.slots)
        out = np.zeros((n, len(self.langs)))
        for w in range(len(self.masks)):
            found = self.masks[w, at[0]]
            for s in at[1:]:
                found &= self.masks[w, s]
            for l in range(64 * w, min(64 * w + 64, len(self.langs))):
                hit = (found >> np.uint64(l % 64)) & np.uint64(1)
                hits = np.bincount(row[hit.astype(bool)], minlength=n)
                out[:, l] = np.maximum(0, (hits - total * self.false[l]) / (1 - self.false[l]))
        return out, total


def learn(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from (doc_id, text, lang)."""
    labelled = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    seen = sorted(labelled.groupBy("lang").count().collect(), key=lambda r: (-r["count"], r["lang"]))
    langs = [r["lang"] for r in seen]
    if not langs:
        return Filters([], [])
    of = {lang: i for i, lang in enumerate(langs)}
    odds = F.create_map(*[F.lit(x) for r in seen for x in (r["lang"], min(1.0, per_language / r["count"]))])
    picked = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < odds[F.col("lang")] * (1 << 20)

    def run(batches):
        for b in _small(batches):
            for first, off, data in text_chunks(b.column(0)):
                row, gram = _grams(off, data)
                lang = np.array([of[x] for x in b.column(1).slice(first, len(off) - 1).to_pylist()], np.uint64)
                both, n = np.unique((lang[row] << np.uint64(32)) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both.astype(np.int64)), pa.array(n)], names=["k", "n"])

    counts = labelled.filter(picked).select("text", "lang").mapInArrow(run, "k long, n long")
    table = counts.groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= MIN_COUNT).toArrow()
    key, n = table["k"].to_numpy().astype(np.uint64), table["n"].to_numpy().astype(float)
    lang, gram = (key >> np.uint64(32)).astype(np.int64), key & np.uint64(0xFFFFFFFF)
    rate = n / np.maximum(1, np.bincount(lang, n, len(langs)))[lang]
    own, at = np.unique(gram, return_inverse=True)
    best = np.zeros(len(own))
    np.maximum.at(best, at, rate)
    typical = rate >= SHARE * best[at]
    return Filters(langs, [gram[typical & (lang == i)] for i in range(len(langs))])


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, known): score is the language's share of all
    corrected counts, known its share of the text's n-grams."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(filters)  # a fixed number of slots

    def run(batches):
        f = model.value
        for b in _small(batches):
            letter = pc.fill_null(pc.match_substring_regex(b.column(1).cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            lang, score, known = [], [], []
            for first, off, data in text_chunks(b.column(1), STEP_BYTES):
                n = len(off) - 1
                if not f.langs:
                    lang += ["und"] * n
                    score.append(np.zeros(n))
                    known.append(np.zeros(n))
                    continue
                counts, total = f.counts(off, data)
                best, some = counts.argmax(axis=1), letter[first : first + n]
                top = counts[np.arange(n), best]
                lang += [f.langs[i] if ok else "und" for i, ok in zip(best, some)]
                score.append(np.where(some, top / np.maximum(counts.sum(axis=1), 1e-9), 0))
                known.append(np.where(some, np.minimum(1, top / np.maximum(total, 1)), 0))
            cols = [b.column(0), pa.array(lang, pa.string()), *(pa.array(np.concatenate(x) if x else np.zeros(0)) for x in (score, known))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score", "known"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, known double")


def fit(docs: DataFrame) -> Filters:
    """Filters from the rows of ``docs`` that aren't held out."""
    return learn(docs.filter(crc_mod("doc_id", 4) != 2).select("doc_id", "text", "lang"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is told."""
    spark, filters, names = docs.sparkSession, fit(docs), docs.columns
    model, text = spark.sparkContext.broadcast(filters), names.index("text")

    def run(batches):
        f = model.value
        for b in _small(batches):
            col = b.column(text)
            letter = pc.fill_null(pc.match_substring_regex(col.cast(pa.large_string()), r"\p{L}"), False).to_numpy(zero_copy_only=False)
            told = [f.counts(off, data)[0].max(axis=1, initial=0) > 0 for _, off, data in text_chunks(col, STEP_BYTES)]
            yield b.filter(pa.array(np.concatenate(told) & letter if told else letter))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs, fit(docs))
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
