"""Operator 3: personal data, and terms that reveal it, by corpus statistics.

Base spans are e-mail addresses, IP addresses, card and phone numbers. Around
each of them the words of a window are its context. Over the corpus, the
co-occurrence of a term t with an entity e gives how much t reveals of e: with
P(t|e) the share of e's texts that have t in e's context, and P(t) the share of
all documents that have t,

    PMI(t; e) = log2(P(t|e) / P(t)),    IC(e) = -log2 P(e),

a term discloses e if it stands with it in CERTAIN of e's texts at least, and
PMI(t; e) >= DISCLOSED * IC(e): it gives away that share of what naming e would.
P(t|e) is smoothed by one text without t. Entities of any support are tested: one
that stands in a single text is disclosed by the rare terms near it. Such terms become spans of kind ``term``
wherever they stand in a document that holds e; the window only serves to learn them. ``sanitise`` generalises base spans to their kind and removes terms.

All counts (of e, t, both and the whole) are of different texts: copies are one
piece of evidence. Joins are over context rows, which are as many as base spans
allow, and over one text of each group of copies.

Defined results: null and empty texts have no spans; rows that repeat come out
as often; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, spread_join

#: Kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone", "term")
WINDOW = 60
CERTAIN = 0.5
#: Digests of copied texts that are broadcast; more are joined by shuffle.
BROADCAST = 500_000
DISCLOSED = 0.8

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"\w{3,}")


def _emails(text: str):
    """As the pattern finds them, but from each @ outwards: linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", at + 1 if not m else m.end())


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of base spans by start, then kind."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _label(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _context(text: str, spans) -> list[dict]:
    """The terms within WINDOW characters of a span, outside all spans."""
    out, covered = [], []  # disjoint stretches that spans cover, in order
    for a, _, b in spans:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [c[0] for c in covered]
    for a, k, b in spans:
        entity = KINDS[k] + ":" + text[a:b].lower()
        out.append({"entity": entity, "term": ""})  # also where no term is near
        for lo, hi in ((max(0, a - WINDOW), a), (b, b + WINDOW)):
            for m in _TERM.finditer(text, lo, min(hi, len(text))):
                s, e = m.span()
                if (s == lo and lo and text[s - 1].isalnum()) or (e == hi and e < len(text) and text[e].isalnum()):
                    continue
                i = bisect_left(starts, e) - 1  # the last stretch that starts before the term ends
                if i < 0 or covered[i][1] <= s:
                    out.append({"entity": entity, "term": m.group().lower()})
    return out


def _places(text: str, terms: set[str]) -> list[dict]:
    """Every occurrence of the terms outside all base spans."""
    spans, out, k, end = base_spans(text), [], 0, 0
    for m in _TERM.finditer(text):
        s, e = m.span()
        while k < len(spans) and spans[k][0] < e:
            end, k = max(end, spans[k][2]), k + 1
        if s >= end and m.group().lower() in terms:
            out.append({"start": s, "end": e})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest, own, n_email, n_ip, n_card, n_phone, base, context, body) of each row;
    own is the text's digest; digest and body are it and the text where there are spans."""
    schema = "doc_id long, digest binary, own binary, n_email long, n_ip long, n_card long, n_phone long, base string, context array<struct<entity:string,term:string>>, body string"
    context = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string())]))

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            spans = [base_spans(t) for t in texts]
            own = [hashlib.sha256(t.encode()).digest() for t in texts]
            cols = [b.column(0), pa.array([d if s else None for d, s in zip(own, spans)], pa.binary()), pa.array(own, pa.binary())]
            cols += [pa.array([sum(s[1] == k for s in got) for got in spans], pa.int64()) for k in range(4)]
            cols += [pa.array(map(_label, spans), pa.string()), pa.array([_context(t, s) for t, s in zip(texts, spans)], context)]
            cols += [pa.array([t if s else None for t, s in zip(texts, spans)], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "digest", "own", "n_email", "n_ip", "n_card", "n_phone", "base", "context", "body"])

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, schema)


def term_documents(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): the number of different texts that have a term. All rows count, and
    of each text that is there more than once one row takes off what its copies add, so
    only those texts move."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    copied = materialise(found.groupBy("own").agg((1 - F.count("*")).alias("weight")).filter("weight < 0"), "copied")
    if copied.count() <= BROADCAST:
        copied = F.broadcast(copied)
    again = docs.select(text.alias("text"), F.unhex(F.sha2(text, 256)).alias("own")).join(copied, "own")
    again = again.groupBy("own").agg(F.first("text").alias("text"), F.first("weight").alias("weight"))

    def run(batches):
        for b in batches:
            n = Counter()
            for t, weight in zip(*(b.column(i).to_pylist() for i in (0, 1))):
                for term in {x.lower() for x in _TERM.findall(t or "")}:
                    n[term] += weight
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["term", "n"])

    rows = docs.select(text.alias("text"), F.lit(1).cast("long").alias("weight"))
    counts = rows.mapInArrow(run, "term string, n long").union(again.select("text", "weight").mapInArrow(run, "term string, n long"))
    return counts.groupBy("term").agg(F.sum("n").alias("df"))


def disclosing(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(entity, term, pmi, ic) of terms that disclose an entity."""
    n = found.select("own").distinct().count()
    near = found.filter("base <> ''").select("digest", F.explode("context").alias("c")).select("digest", "c.entity", "c.term").distinct()
    entities = near.groupBy("entity").agg(F.count_distinct("digest").alias("texts"))
    both = near.groupBy("entity", "term").agg(F.count("*").alias("both"))
    got = both.join(entities, "entity").filter(F.col("both") >= CERTAIN * F.col("texts")).join(term_documents(docs, found, text_col), "term")
    got = got.withColumn("pmi", F.log2(F.col("both") / (F.col("texts") + 1) / (F.col("df") / F.lit(n)))).withColumn("ic", F.log2(F.lit(n) / F.col("texts")))
    return got.filter(F.col("pmi") >= DISCLOSED * F.col("ic")).select("entity", "term", "pmi", "ic")


def protect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan``'s columns and ``terms``: (start, end) of disclosing terms."""
    found = materialise(scan(docs, id_col, text_col), "pii")
    flagged = materialise(disclosing(docs, found, text_col), "terms")
    held = found.filter("base <> ''")
    entities = held.select("digest", F.explode("context").alias("c")).select("digest", "c.entity").distinct()
    terms = entities.join(flagged, "entity").groupBy("digest").agg(F.collect_set("term").alias("terms"))
    texts = held.groupBy("digest").agg(F.first("body").alias("body"), F.count("*").alias("copies"))

    def run(batches):
        for b in batches:
            places = [_places(t, set(own)) for t, own in zip(*(b.column(i).to_pylist() for i in (2, 3)))]
            place = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(places, place)], names=["digest", "copies", "terms"])

    hit = texts.join(terms, "digest").select("digest", "copies", "body", "terms")
    hit = hit.mapInArrow(run, "digest binary, copies long, terms array<struct<start:int,end:int>>")
    found = found.drop("body")
    return spread_join(found, hit, "digest", "copies", F.xxhash64("doc_id"))


def _cut(text: str, base: str, terms) -> str:
    """Base spans as their kind in brackets, overlapping ones as one, by the kind that
    starts first; terms go."""
    cuts = sorted((int(a), int(e), f"[{k.upper()}]") for k, a, e in (s.split(":") for s in base.split(",") if s))
    cuts = sorted([*cuts, *((t["start"], t["end"], "") for t in terms or ())], key=lambda c: c[0])
    out, done = [], 0
    for a, e, new in cuts:
        if a >= done:
            out += [text[done:a], new]
        done = max(done, e)
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): base spans generalised to ``[KIND]``, terms removed; a null text
    stays null. Rows meet their spans by digest, hot ones by broadcast."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    found = materialise(protect(rows).filter("base <> ''").groupBy("digest").agg(F.first("base").alias("base"), F.first("terms").alias("terms"), F.count("*").alias("copies")), "spans")
    rows = spread_join(rows, found, "digest", "copies", F.xxhash64("doc_id")).select("doc_id", "text", "base", "terms")

    def run(batches):
        for b in batches:
            out = [t if not base else _cut(t, base, terms) for t, base, terms in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = protect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    order = {k: i for i, k in enumerate(KINDS)}
    start = lambda s: F.split(s, ":")[1].cast("int")
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    base = F.transform(F.split("base", ","), lambda s: F.struct(start(s).alias("a"), rank[F.split(s, ":")[0]].alias("k"), s.alias("s")))
    terms = F.transform("terms", lambda t: F.struct(t["start"].alias("a"), F.lit(4).alias("k"), F.concat(F.lit("term:"), t["start"], F.lit(":"), t["end"]).alias("s")))
    every = F.array_join(F.transform(F.array_sort(F.concat(base, terms)), lambda x: x["s"]), ",")
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(every)
    return rows.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"))
