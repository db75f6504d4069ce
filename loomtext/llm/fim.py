"""Operator 11: fill-in-middle transformation by escaped marker injection.

A control character serves as the delimiter. It is escaped where a text has it,
so that ``regexp_replace`` can append a bare one after every unit; the units are
then counted, ``substring_index`` cuts the marked text at the ranks that a hash
of the id draws, and each part is stripped of its delimiters and unescaped. An
escape stands for one character that isn't white space by two that aren't, so
units stay what they are. One pass over the table, built-in functions only,
nothing moves.

Defined results: null text counts as empty; an empty text, and one that has a
sentinel in it, stays plain (its length in units is still told); a null id draws
what the empty string draws; rows that repeat an id draw alike; texts of any
length are cut whole, in a small multiple of their own size; delimiters and
escapes inside a text survive; an empty table gives an empty result; other
columns, whatever their names, go through ``transform`` unread, unless they have
the name of one of its outputs, which then takes their place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: A unit: white space and the word behind it, or white space that ends the text.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Delimiter and escape: one byte each, no white space. Escaped forms: the escape and a letter.
DELIMITER, ESCAPE = "\x1f", "\x1e"

ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  CAST('0x' || h[1:8] AS UBIGINT) AS h1, CAST('0x' || h[9:16] AS UBIGINT) AS h2, CAST('0x' || h[17:24] AS UBIGINT) AS h3, CAST('0x' || h[25:32] AS UBIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST(h1 % (len(units) + 1) AS BIGINT) AS x, CAST(h2 % (len(units) + 1) AS BIGINT) AS y,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(units[1:least(x, y)], '') AS prefix, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(units[greatest(x, y) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def marked(text: Column, unit: str = UNIT) -> Column:
    """The escaped text with a delimiter after each unit."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))
    return F.regexp_replace(escaped, unit, f"$0{DELIMITER}")


def unmarked(part: Column) -> Column:
    """A piece of a marked text as it was."""
    bare = F.replace(part, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def _ranked(text: str, first: str, last: str) -> Column:
    """Units ``first`` + 1 to ``last`` of a marked text, by the columns that hold the ranks."""
    upto = F.expr(f"substring_index({text}, '\\u001f', CAST({last} AS INT))")
    return F.when(F.col(last) > F.col(first), unmarked(F.call_function("substring_index", upto, F.lit(DELIMITER), (F.col(first) - F.col(last)).cast("int")))).otherwise(F.lit(""))


def draws(key: Column, seed: int, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers of a key: the first groups of a seeded SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(n)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = 50, spm: int = 80, seed: int = 42, unit: str = UNIT) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if
    plain) and ``output``. ``rate`` percent of the texts are rearranged, ``spm``
    percent of those with the suffix first."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), F.array(*draws(F.col(id_col), seed)).alias("h"))
    rows = rows.withColumn("marked", marked(F.col("text"), unit))
    rows = rows.withColumn("n", F.expr("length(marked) - length(replace(marked, '\\u001f', ''))").cast("long"))
    x, y = F.col("h")[0] % (F.col("n") + 1), F.col("h")[1] % (F.col("n") + 1)
    taken = F.lit(False)
    for s in SENTINELS:
        taken |= F.contains("text", F.lit(s))
    plain = (F.col("text") == "") | taken | (F.col("h")[2] % 100 >= rate)
    form = F.when(plain, PLAIN).when(F.col("h")[3] % 100 < spm, SPM).otherwise(PSM)
    rows = rows.select("row", "text", "n", form.alias("form"), F.lit(0).cast("long").alias("zero"), F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(~plain, F.col("marked")).alias("marked"))
    parts = [("prefix", "zero", "a"), ("middle", "a", "b"), ("suffix", "b", "n")]
    rows = rows.select("row", "text", "n", "form", *[_ranked("marked", i, j).alias(name) for name, i, j in parts])
    cut = F.col("form") != PLAIN
    output = (
        F.when(~cut, F.col("text"))
        .when(F.col("form") == PSM, F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
    )
    made = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(cut, F.length("prefix").cast("long")), "middle_chars": F.when(cut, F.length("middle").cast("long")), "output": output}
    lower = {name.lower() for name in made}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in lower]
    return rows.select(*kept, *[c.alias(name) for name, c in made.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made of. The cut is exact: a text with a
    sentinel in it is never rearranged, and none can arise where parts meet, as a
    sentinel starts with ``<`` and ends with ``>``."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sha = lambda c: F.sha2(c, 256)
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))
