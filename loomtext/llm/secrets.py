"""Operator 8: secret scans with a trigram inverted index. Built-in functions only.

For each rule's regex the strings that every match must contain are derived, and
from them a Boolean query over trigrams: an AND over mandatory runs of an OR over
their alternatives of an AND of trigrams that cover the alternative.

The index has a posting for each trigram and block of rows: a bitmap of the rows
whose lower-cased text has the trigram. A row's address is its file and place in
it; a block is BLOCK rows of a file. A rule's query intersects and unites the
bitmaps of a block, and what is left are the rule's candidates. Texts never move:
they are read where they lie, once to be indexed and once to be verified with the
regexes, a rule's own on its candidates only, and a rule without mandatory
trigrams on all of them, in that second reading. Candidate bitmaps come by
broadcasts of at most BROADCAST_BYTES; where all of them are more, files are dealt
to groups that stay below it, and each group's files are read with their own.

Rows that can't be addressed (no file, or made by a join) are written down first.
Two blocks whose 64-bit address is the same would share bitmaps: more candidates,
same result.

Defined results: null counts as empty and has no spans; rows that repeat come out
as often; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import materialise

#: At most so many alternatives are spelt out for a run of literals.
ALTERNATIVES = 64
#: Rows of a block, as many as Spark's bitmaps have bits, and a bitmap's bytes.
BLOCK = 32768
BITMAP_BYTES = BLOCK // 8
BROADCAST_BYTES = 128 << 20
#: Matches of a text that are added up in one fold.
_FOLD = 256


class Rule(NamedTuple):
    kind: str
    #: In the syntax that Java, Python and RE2 share; ``(?i:...)`` for either case.
    regex: str
    #: A match counts if this group (0: the match) has so many characters.
    group: int
    least: int


#: The base kinds, in the order in which they are listed.
RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Rules that the scan adds: published shapes of credentials.
ADDED = [
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}", 0, 1),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 1),
    Rule("login", r"://[^\x00-\x20/:@]{1,64}:[^\x00-\x20/:@]{3,64}@", 0, 1),
]


def _spelt(nodes) -> set[str] | None:
    """All strings that a sequence of regex nodes matches, in lower case; None if
    they are more than ALTERNATIVES or not literal."""
    out = {""}
    for op, arg in nodes:
        kind = str(op)
        if kind == "LITERAL":
            own = {chr(arg).lower()}
        elif kind == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            own = {chr(c).lower() for _, c in arg}
        elif kind == "SUBPATTERN":
            own = _spelt(arg[-1])
        elif kind == "BRANCH":
            parts = [_spelt(b) for b in arg[1]]
            own = None if None in parts else set().union(*parts)
        elif kind == "MAX_REPEAT" and arg[:2] == (0, 1):
            own = _spelt(arg[2])
            own = own and own | {""}
        else:
            own = None
        if own is None or len(own) * len(out) > ALTERNATIVES:
            return None
        out = {a + b for a, b in itertools.product(out, own)}
    return out


def _cover(s: str) -> frozenset[str]:
    """Trigrams that leave no character of ``s`` out."""
    return frozenset(s[i : i + 3] for i in [*range(0, len(s) - 2, 3), len(s) - 3])


def trigram_query(regex: str) -> list[list[frozenset[str]]]:
    """The rule's query: runs (AND) of alternatives (OR) of trigrams (AND), in lower
    case. Empty: nothing is mandatory, all texts are candidates."""
    runs, now = [], {""}
    for node in [*re._parser.parse(regex), None]:
        own = node and _spelt([node])
        if own and len(own) * len(now) <= ALTERNATIVES:
            now = {a + b for a, b in itertools.product(now, own)}
        else:
            runs.append(now)
            now = own or {""}
    runs.append(now)
    runs = [{s for s in run if not any(o in s for o in run - {s})} for run in runs]  # who has s has o
    return [sorted({_cover(s) for s in run}, key=sorted) for run in runs if all(len(s) > 2 for s in run)]


def _located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, file, block, bit): a block is BLOCK rows of a file, bit the
    row's place in it; file and block are hashes."""
    cols = [F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")]
    at = [F.col("_metadata.file_path").alias("path"), (F.col("_metadata.row_index") + 1).alias("row")]
    try:
        rows = None if "_metadata" in docs.columns else docs.select(*cols, *at)
    except AnalysisException:
        rows = None
    if rows is None:
        rows = materialise(docs.select(*cols), "texts").select("doc_id", "text", *at)
    path, row = F.coalesce("path", F.lit("")), F.coalesce("row", F.lit(1))
    block = F.xxhash64(path, F.bitmap_bucket_number(row))
    return rows.select("doc_id", "text", F.xxhash64(path).alias("file"), block.alias("block"), F.bitmap_bit_position(row).alias("bit"))


def postings(rows: DataFrame, grams: list[str]) -> DataFrame:
    """The index: (file, block, gram, bits); bits has the rows of a block whose
    lower-cased text contains the trigram, gram is its number."""
    low = rows.select("file", "block", "bit", F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    hits = low.select("file", "block", "bit", F.explode(has).alias("gram"))
    return hits.groupBy("file", "block", "gram").agg(F.bitmap_construct_agg("bit").alias("bits"))


def candidates(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """(file, block, one bitmap for each rule with a query, named b0, b1, ... by the
    rule's number), blocks with a candidate only."""
    queries = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.regex))}
    grams = sorted({g for q in queries.values() for run in q for alt in run for g in alt})
    number = {g: i for i, g in enumerate(grams)}
    lines = [(number[g], i, j, k, len(alt), len(q)) for i, q in queries.items() for j, run in enumerate(q) for k, alt in enumerate(run) for g in sorted(alt)]
    names = ("gram", "rule", "run", "alt", "all_grams", "all_runs")
    asked = rows.sparkSession.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, line)]) for line in lines])))
    met = postings(rows, grams).join(F.broadcast(asked), "gram").repartition("block")
    key = ["file", "block", "rule", "all_runs"]
    alts = met.groupBy(*key, "run", "alt", "all_grams").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter("n = all_grams")
    runs = alts.groupBy(*key, "run").agg(F.bitmap_or_agg("bits").alias("bits"))
    found = runs.groupBy(*key).agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).filter((F.col("n") == F.col("all_runs")) & (F.bitmap_count("bits") > 0))
    return found.groupBy("file", "block").agg(*[F.max(F.when(F.col("rule") == i, F.col("bits"))).alias(f"b{i}") for i in queries])


def _groups(found: DataFrame, own: int, limit: int) -> int:
    """Into how many groups files are dealt, so that the candidate bitmaps of each
    take ``limit`` bytes at most (or are those of one file)."""
    files = found.groupBy("file").count()
    n, blocks = files.agg(F.count("*"), F.sum("count")).first()
    groups = max(1, math.ceil((blocks or 0) * own * BITMAP_BYTES / limit))
    groups = 1 if groups == 1 else min(2 * groups, n)  # hashes don't deal evenly
    while 1 < groups < n:
        most = files.groupBy(F.pmod("file", F.lit(groups))).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if most * own * BITMAP_BYTES <= limit:
            break
        groups = min(2 * groups, n)
    return groups


def _bit(bits: Column, bit: Column) -> Column:
    """Is the bit set? A missing bitmap has none."""
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.bit_get(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def _ends(sizes: Column) -> Column:
    """Running sums of an array, _FOLD at a time: a fold copies what it has so far."""
    none = F.array().cast("array<bigint>")
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(sizes), F.lit(1)) - 1) / _FOLD).cast("int")), lambda k: F.slice(sizes, k * _FOLD + 1, F.lit(_FOLD)))
    sums = F.transform(parts, lambda p: F.aggregate(p, none, lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x))))
    tops = F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + F.coalesce(F.try_element_at(s, F.lit(-1)), F.lit(0).cast("long")))))
    return F.flatten(F.zip_with(sums, F.slice(tops, F.lit(1), F.size(sums)), lambda s, t: F.transform(s, lambda x: x + t)))


def _spans(text: Column, rule: Rule, order: int, ask: Column) -> Column:
    """The rule's spans in a text: array of (start, kind's number, label), code points.
    A match's end is the sum of all gaps and matches up to it."""
    pattern = F.lit(rule.regex)
    empty = F.array().cast("array<struct<start:bigint,kind:int,label:string>>")
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.length(m).cast("long"))
    counted = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length)
    gaps = F.slice(F.transform(F.split(text, rule.regex, -1), lambda g: F.length(g).cast("long")), F.lit(1), F.size(sizes))
    ends = _ends(F.zip_with(gaps, sizes, lambda g, s: g + s))
    every = F.transform(F.arrays_zip(ends.alias("e"), sizes.alias("s"), counted.alias("n")), lambda x: F.when(x["n"] >= rule.least, F.struct((x["e"] - x["s"]).alias("start"), F.lit(order).alias("kind"), F.concat(F.lit(rule.kind + ":"), (x["e"] - x["s"]).cast("string"), F.lit(":"), x["e"].cast("string")).alias("label"))))
    return F.when(ask & F.regexp_like(text, pattern), F.array_compact(every)).otherwise(empty)


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text, one array of spans for each rule, named by its kind)."""
    rules = RULES + ADDED if rules is None else rules
    rows = _located(docs, id_col, text_col)
    indexed = [bool(trigram_query(r.regex)) for r in rules]
    ask = [_bit(F.col(f"b{i}"), F.col("bit")) if own else F.lit(True) for i, own in enumerate(indexed)]
    spans = ["doc_id", "text", *[_spans(F.col("text"), r, i, a).alias(r.kind) for i, (r, a) in enumerate(zip(rules, ask))]]
    if not any(indexed):
        return rows.select(*spans)
    found = materialise(candidates(rows, rules), "candidates")
    groups = _groups(found, sum(indexed), broadcast_bytes)
    out = None
    for g in range(groups):
        mine = lambda df: df if groups == 1 else df.filter(F.pmod("file", F.lit(groups)) == g)  # noqa: B023, E731
        part = mine(rows).join(F.broadcast(mine(found).drop("file")), "block", "left").select(*spans)
        out = part if out is None else out.union(part)
    return out


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda rules: F.array_join(F.transform(F.array_sort(F.concat(*[r.kind for r in rules])), lambda s: s["label"]), ",")
    counts = [F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in RULES]
    found = found.select("doc_id", *counts, listed(RULES).alias("base"), listed(RULES + ADDED).alias("spans"))
    return found.select("doc_id", *[f"n_{r.kind}" for r in RULES], F.sha2("base", 256).alias("base_sha256"), "spans")


def _oracle() -> str:
    """Regex spans without an index: what the query must equal."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    ctes = ["t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)"]
    for i, rule in enumerate(RULES + ADDED):
        p = quoted(rule.regex)
        cut = f"SELECT r, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, regexp_extract_all(text, {p}, {rule.group}) AS parts FROM t WHERE regexp_matches(text, {p})"
        each = f"SELECT r, unnest(range(1, len(hits) + 1)) AS i, unnest(list_transform(gaps[1:len(hits)], lambda x: length(x))) AS gap, unnest(list_transform(hits, lambda x: length(x))) AS size, unnest(list_transform(parts, lambda x: length(x))) AS n FROM ({cut})"
        ends = f"SELECT r, n, size, sum(gap + size) OVER (PARTITION BY r ORDER BY i) AS e FROM ({each})"
        ctes.append(f"k{i} AS (SELECT r, {i} AS kind, CAST(e - size AS BIGINT) AS a, '{rule.kind}:' || CAST(e - size AS BIGINT) || ':' || CAST(e AS BIGINT) AS label FROM ({ends}) WHERE n >= {rule.least})")
    ctes.append("s AS (" + " UNION ALL ".join(f"SELECT * FROM k{i}" for i in range(len(ctes) - 1)) + ")")
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(RULES))
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)
    ctes.append(f"g AS (SELECT r, {counts}, string_agg(label, ',' ORDER BY a, kind) FILTER (kind < {len(RULES)}) AS base, string_agg(label, ',' ORDER BY a, kind) AS spans FROM s GROUP BY r)")
    return f"WITH {', '.join(ctes)} SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (r)"


ORACLE = _oracle()
