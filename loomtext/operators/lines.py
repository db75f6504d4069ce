"""Line classifiers and the joining of wrapped lines."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.sources.shared import small

#: Ends after which a long line isn't taken to go on.
CLOSED = (".", "!", "?", ":", '"', "'", ">", "}", "]", ")")
ENCYCLOPEDIA, FACTBOOK = "encyclopedia", "factbook"


def is_section_header(line: Column) -> Column:
    """All capitals without a comma, or short, capital first and no sentence end."""
    s = F.trim(line)
    caps = s.rlike(r"\p{Lu}") & (F.upper(s) == s) & ~F.contains(s, F.lit(","))
    short = s.rlike(r"^\p{Lu}") & (F.length(s) < 20) & ~s.rlike(r"[.!?]$") & ~(s.rlike(r"\p{Lu}") & (F.upper(s) == s))
    return ~s.rlike("[,;]$") & (F.regexp_count(s, F.lit(",")) < 3) & (F.length(s) < 80) & (caps | short)


def starts_with_label(line: Column) -> Column:
    """Up to three words, capital first, before a colon among the first 30 characters."""
    s = F.trim(line)
    at = F.instr(s, ":")
    head = F.trim(F.substring(s, F.lit(1), at - 1))
    return (at > 0) & (at <= 30) & (F.regexp_count(head, F.lit(r"\S+")) <= 3) & head.rlike(r"^\p{Lu}")


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\x0b\x0c"))


def least_size(line: Column) -> Column:
    """How long the lines joined so far must be to go on after this one, by its end: any
    length after a lower-case letter, comma or semicolon, 31 after a parenthesis, 36 after
    what closes nothing; null if they may not (D4)."""
    s = stripped(line)
    return F.when(s.rlike(r"[\p{Ll},;]$"), 0).when(s.endswith(")"), 31).when(_open(s), 36)


def _open(s: Column) -> Column:
    return ~s.rlike("[" + "".join("\\" + c for c in CLOSED) + "]$")


def stands_alone(line: Column) -> Column:
    """Whether a line never goes on another, whatever that is."""
    s = stripped(line)
    return s.startswith("@") | is_section_header(s) | F.contains(s, F.lit(":"))


def should_join(line: Column, following: Column) -> Column:
    """Does a wrapped line go on in the next (D4)?"""
    both = (stripped(line) == "") & (stripped(following) == "")
    return ~both & ~stands_alone(following) & F.coalesce(F.length(stripped(line)) >= least_size(line), F.lit(False))


def is_poetry(line: Column, following: Column, before: Column, all_indented: Column) -> Column:
    """Indented, or short beside a short next line; where all lines are indented, only
    by another indent than a neighbour's (D3)."""
    indent = lambda x: F.length(x) - F.length(F.ltrim(x))
    size = lambda x: F.length(F.trim(x))
    some = lambda x: F.coalesce(x != "", F.lit(False))
    off = lambda x: some(x) & (F.abs(indent(line) - indent(x)) > 2)
    starts = line.rlike("^[ \t]")
    return F.when(all_indented, starts & (off(before) | off(following))).otherwise(starts | ((size(line) < 60) & some(following) & (F.coalesce(size(following), F.lit(99)) < 60)))


def joined(docs: DataFrame, mode: str = "") -> DataFrame:
    """(doc_id, text) with wrapped lines joined (D5). Each line is first told by the rules
    above, all in one projection: its size, the sizes after which another may follow, whether
    it stands alone and whether it stays as it is. What is left is one pass over these
    numbers, as only the size depends on all lines joined before."""
    docs = docs.select("doc_id", F.split("text", "\n", -1).alias("lines"))
    full = F.filter("lines", lambda x: stripped(x) != "")
    docs = docs.withColumn("flat", (F.size(full) > 0) & F.forall(full, lambda x: x.rlike("^[ \t]")))
    near = lambda i: F.get("lines", i)
    verse = F.lit(False) if mode in (ENCYCLOPEDIA, FACTBOOK) else None
    never = F.lit(1 << 30)
    told = {
        "size": F.transform("lines", lambda x: F.length(stripped(x))),
        "least": F.transform("lines", lambda x: F.coalesce(least_size(x), never)),
        "always": F.transform("lines", lambda x: F.when(_open(stripped(x)), 91).otherwise(never) if mode == ENCYCLOPEDIA else never),
        "alone": F.transform("lines", stands_alone),
        "kept": F.transform("lines", lambda x, i: verse if verse is not None else is_poetry(x, near(i + 1), F.when(i > 0, near(i - 1)), F.col("flat"))),
    }

    def run(batches):
        for b in small(batches):
            out = []
            for row in zip(*(c.to_pylist() for c in b.columns[1:])):
                out.append(None if row[0] is None else "\n".join(_texts(*row)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return docs.select("doc_id", "lines", *[c.alias(n) for n, c in told.items()]).mapInArrow(run, "doc_id long, text string")


def _texts(lines: list[str], size: list[int], least: list[int], always: list[int], alone: list[bool], kept: list[bool]) -> Iterator[str]:
    """The lines, those that belong together as one."""
    first = 0
    while first < len(lines):
        end, total = first + 1, size[first]
        if size[first] and not kept[first]:
            while end < len(lines) and size[end] and total >= (always[end - 1] if alone[end] else min(always[end - 1], least[end - 1])):
                total, end = total + 1 + size[end], end + 1
        own = lines[first:end]
        if len(own) > 1:
            own = [own[0].rstrip(), *(x.strip() for x in own[1:-1]), own[-1].lstrip()]
        yield " ".join(own)
        first = end
