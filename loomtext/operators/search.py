"""Many words in every text at once (F3), and windows that texts share."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.operators.dedup import counted_windows
from loomtext.sources.shared import checkpointed

#: Words of an automaton; more are searched in further passes.
PASS_WORDS = 200_000
#: Windows of so many texts come by broadcast, of which there can't be many.
HOT = 1000


def substring_counts(texts: DataFrame, words: DataFrame, text_col: str = "text", pass_words: int = PASS_WORDS) -> DataFrame:
    """(word, matches): non-overlapping matches of each distinct word in all texts, by an
    Aho-Corasick automaton that reads a text once; sums are formed before they move. Words
    beyond ``pass_words`` take further passes, each written down before the next is
    planned, so that one pass's words are held at a time."""
    words = words.select("word").filter("word <> ''").distinct()
    passes = max(1, math.ceil(words.count() / pass_words))
    found = None
    for p in range(passes):
        own = [r["word"] for r in words.filter(F.pmod(F.xxhash64("word"), F.lit(passes)) == p).collect()]
        part = _counts(texts.select(F.col(text_col).alias("text")), own).groupBy("word").agg(F.sum("matches").alias("matches"))
        part = checkpointed(part) if passes > 1 else part
        found = part if found is None else found.union(part)
    sums = found.groupBy("word").agg(F.sum("matches").alias("matches"))
    return words.join(sums, "word", "left").select("word", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))


def _counts(texts: DataFrame, words: list[str]) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import ahocorasick

        find = ahocorasick.Automaton()
        for w in held.value:
            find.add_word(w, w)
        if not held.value:
            return
        find.make_automaton()
        n = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                free = {}  # from where on a word's next match may start
                for end, w in find.iter(text or ""):
                    if end - len(w) >= free.get(w, -1):
                        free[w] = end
                        n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "matches"])

    return texts.select(F.lower("text").alias("text")).mapInArrow(run, "word string, matches long")


def window_holders(docs: DataFrame, width: int = 100, stride: int = 25) -> DataFrame:
    """(ord, holder, windows): how many different windows (one every ``stride``
    characters) each text has that ``holder`` is the first to have. Pairs of texts that
    share windows meet in their holder; only hashes move."""
    own = counted_windows(docs.filter("text IS NOT NULL"), width, stride).select("ord", "h", "g").distinct()
    first = own.groupBy("h", "g").agg(F.min("ord").alias("holder"), F.count("*").alias("n")).filter("n > 1")
    hot = first.filter(F.col("n") > HOT).orderBy(F.col("n").desc(), "h", "g").limit(HOT).select("h", "g", F.col("holder").alias("hot"))
    rows = own.join(F.broadcast(hot), ["h", "g"], "left")
    usual = rows.filter("hot IS NULL").drop("hot").join(first.select("h", "g", "holder"), ["h", "g"], "left")
    every = usual.select("ord", "holder").union(rows.filter("hot IS NOT NULL").select("ord", "hot"))
    return every.groupBy("ord", F.coalesce("holder", "ord").alias("holder")).agg(F.count("*").alias("windows"))
