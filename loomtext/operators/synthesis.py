"""Arithmetic questions and answers (K15): a grammar as tables, every choice a number of the row.

A form says which kind of phrase it takes and whether an opener stands before it; a
phrase of an operation and kind names the operands; an answer names the result. Rows
bring numbers, which are taken modulo what there is to choose from, so the same rows
give the same questions.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = ("ADD", "SUBTRACT", "MULTIPLY", "DIVIDE")
#: Digits of the operands, whose signs are free: one to five.
MAGNITUDES = (9, 99, 999, 9999, 99999)
SIGNS = {"ADD": ("+", "plus"), "SUBTRACT": ("-", "minus"), "MULTIPLY": ("×", "*", "times"), "DIVIDE": ("÷", "/", "divided by")}

#: Kinds of phrases: what one is told to do, what one asks for, and how one names the result.
TASK, ASKED, NAMED = "task", "asked", "named"


class Form(NamedTuple):
    """``{p}`` is the phrase, ``{o}`` an opener; ``ends`` is put behind what has no mark."""

    text: str
    kinds: tuple[str, ...]
    ends: str = "."


FORMS = (
    Form("{o} {p}", (TASK,)),
    Form("{p}?", (ASKED,), "?"),
    Form("I want to {p}", (TASK,)),
    Form("Would you help me to {p}?", (TASK,), "?"),
    Form("{p}", (TASK, ASKED, NAMED)),
    Form("What is {p}?", (NAMED,), "?"),
    Form("How is {p} worked out?", (NAMED,), "?"),
    Form("Give me {p}", (ASKED, NAMED)),
)
OPENERS = ("How should I", "What do I do to", "Explain to me how to", "Teach me to", "Please", "In one step,", "Let us", "How would you")


class Phrase(NamedTuple):
    """``ordered``: the operands may not change places."""

    op: str
    kind: str
    text: str
    ordered: bool = False


PHRASES = (
    Phrase("ADD", TASK, "add {b} onto {a}"), Phrase("ADD", TASK, "sum {a} and {b}"), Phrase("ADD", TASK, "total {a} with {b}"),
    Phrase("ADD", ASKED, "{a} + {b}"), Phrase("ADD", ASKED, "{a} plus {b}"), Phrase("ADD", ASKED, "{a} and {b} together"),
    Phrase("ADD", NAMED, "the sum of {a} and {b}"), Phrase("ADD", NAMED, "{a} increased by {b}"),
    Phrase("SUBTRACT", TASK, "take {b} away from {a}", True), Phrase("SUBTRACT", TASK, "lower {a} by {b}"), Phrase("SUBTRACT", TASK, "subtract {b} from {a}", True),
    Phrase("SUBTRACT", ASKED, "{a} - {b}"), Phrase("SUBTRACT", ASKED, "{a} minus {b}"), Phrase("SUBTRACT", ASKED, "{b} taken from {a}", True),
    Phrase("SUBTRACT", NAMED, "the difference of {a} and {b}"), Phrase("SUBTRACT", NAMED, "{a} less {b}"),
    Phrase("MULTIPLY", TASK, "multiply {a} with {b}"), Phrase("MULTIPLY", TASK, "scale {a} by {b}"), Phrase("MULTIPLY", TASK, "take {a} {b} times"),
    Phrase("MULTIPLY", ASKED, "{a} × {b}"), Phrase("MULTIPLY", ASKED, "{a} * {b}"), Phrase("MULTIPLY", ASKED, "{a} times {b}"),
    Phrase("MULTIPLY", NAMED, "the product of {a} and {b}"), Phrase("MULTIPLY", NAMED, "{a} scaled by {b}"),
    Phrase("DIVIDE", TASK, "divide {a} by {b}"), Phrase("DIVIDE", TASK, "split {a} by {b}"), Phrase("DIVIDE", TASK, "fit {b} into {a}", True),
    Phrase("DIVIDE", ASKED, "{a} ÷ {b}"), Phrase("DIVIDE", ASKED, "{a} / {b}"), Phrase("DIVIDE", ASKED, "{a} over {b}"),
    Phrase("DIVIDE", NAMED, "the quotient of {a} and {b}"), Phrase("DIVIDE", NAMED, "{b} into {a}", True),
)
ANSWERS = ("{r}", "{a} {s} {b} = {r}", "{a} {s} {b} makes {r}", "It is {r}", "So: {r}", "One gets {r}", "{r}, as {a} {s} {b} shows", "This comes to {r}")
PICKS = ("op", "size", "form", "kind", "opener", "phrase", "swap", "answer", "sign", "x", "y")


def choices(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """(id, ...): the numbers of PICKS for ``n`` questions, by a hash of each id."""
    pick = lambda name: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(name)), F.lit(1 << 40))
    return spark.range(n).select("id", *[pick(k).alias(k) for k in PICKS])


def _one(values: Column, at: str) -> Column:
    return F.element_at(values, (F.col(at) % F.size(values) + 1).cast("int"))


def _list(values) -> Column:
    return F.array(*map(F.lit, values))


def filled(text: Column, **parts: Column) -> Column:
    for name, part in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), part.cast("string"))
    return text


def arithmetic(rows: DataFrame) -> DataFrame:
    """(id, op, a, b, result, question, answer) of rows of numbers (``choices``).

    Divisions come out even, unless the operands change places, which half of the
    questions do whose phrase isn't a task and doesn't say which is which; results are
    rounded down, and nothing is divided by zero."""
    spark = rows.sparkSession
    forms = F.array(*[F.struct(F.lit(f.text).alias("text"), _list(f.kinds).alias("kinds"), F.lit(f.ends).alias("ends")) for f in FORMS])
    grammar = spark.createDataFrame([(p.op, p.kind, i, p.text, p.ordered) for i, p in enumerate(PHRASES)], "op string, own string, rank int, text string, ordered boolean")
    grammar = grammar.groupBy("op", "own").agg(F.sort_array(F.collect_list(F.struct("rank", "text", "ordered"))).alias("phrases"))
    signs = F.create_map(*[c for op, s in SIGNS.items() for c in (F.lit(op), _list(s))])
    rows = rows.withColumns({"op": _one(_list(OPS), "op"), "top": _one(_list(MAGNITUDES), "size").cast("long"), "form": _one(forms, "form")})
    rows = rows.withColumns({"own": _one(F.col("form.kinds"), "kind"), "b": F.col("y") % (2 * F.col("top") + 1) - F.col("top"), "a": F.col("x") % (2 * F.col("top") + 1) - F.col("top")})
    rows = rows.withColumn("b", F.when((F.col("op") == "DIVIDE") & (F.col("b") == 0), 1).otherwise(F.col("b")))
    rows = rows.withColumn("a", F.when(F.col("op") == "DIVIDE", F.col("a") * F.col("b")).otherwise(F.col("a")))
    rows = rows.join(F.broadcast(grammar), ["op", "own"]).withColumn("phrase", _one(F.col("phrases"), "phrase"))  # a few rows, as many as the grammar has
    swap = (F.col("swap") % 2 == 1) & (F.col("own") != TASK) & ~F.col("phrase.ordered")
    rows = rows.withColumn("swapped", swap).withColumns({"a": F.when(swap, F.col("b")).otherwise(F.col("a")), "b": F.when(swap, F.col("a")).otherwise(F.col("b"))})
    down = F.expr("if(b = 0, null, a div b - if(a % b <> 0 and (a < 0) <> (b < 0), 1, 0))")
    result = F.when(F.col("op") == "ADD", F.expr("a + b")).when(F.col("op") == "SUBTRACT", F.expr("a - b")).when(F.col("op") == "MULTIPLY", F.expr("a * b")).otherwise(down)
    rows = rows.withColumn("result", result)
    own = {"a": F.col("a"), "b": F.col("b")}
    question = filled(filled(F.col("form.text"), o=_one(_list(OPENERS), "opener"), p=F.col("phrase.text")), **own)
    question = F.when(F.right(question, F.lit(1)).isin(".", "?", "!"), question).otherwise(F.concat(question, F.col("form.ends")))
    answer = filled(_one(_list(ANSWERS), "answer"), s=_one(F.element_at(signs, F.col("op")), "sign"), r=F.coalesce(F.col("result").cast("string"), F.lit("undefined")), **own)
    return rows.select("id", "op", "a", "b", "result", question.alias("question"), answer.alias("answer"))
