"""Operator 12: Merkle manifest of a dataset, built bottom-up, proofs pushed top-down.

A leaf is the SHA-256 of a row's fields. Leaves are ranked inside their group in
the order of the key, ``fanout`` consecutive nodes become a parent, level by level,
and every level is written down. The groups' last nodes, ranked in turn, give the
root in the same way. Proofs go the other way: the children of a level join their
parents by (group, rank div fanout), take their siblings from the parent's row and
put them before what the parent inherited. A row's parent key is shared by
``fanout`` rows at most, so a group that holds most of the table is no hot key.

Texts are read once, for their two hashes; after that rows of digests move: by
range for the ranks, then by parent for the first level and for the last proofs.
Levels shrink by the fanout, so there are as many small jobs as the tree is high.

Defined results: a null field is ``-``; null groups come first, as do null keys;
of rows that repeat a key the leaf's digest decides the order, and rows that are
alike in all fields are alike in their leaves and have proofs of their own; a text
is hashed whole; an empty table has no row and no root (null); further columns,
whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialise

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
#: Bytes of a digest.
SIZE = 32
_AT = (1 << 33) - 1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_FIELD = "CASE WHEN {c} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END"
_FIELDS = [_FIELD.format(c=c, v=f"CAST({c} AS VARCHAR)") for c in COLUMNS]
_CRC = "xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
ORACLE = f"""
WITH RECURSIVE f AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS m FROM (
    SELECT doc_id, lang, sha256({' || '.join(_FIELDS)}) AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN sha256({' || '.join([*_FIELDS[:-1], _FIELD.format(c='text', v=f"translate(text, '{_UPPER}', '{_LOWER}')")])}) END AS changed FROM documents)),
lv(k, g, i, m, d) AS (
  SELECT CAST(0 AS BIGINT), lang, i, m, leaf FROM f
  UNION ALL SELECT k + 1, g, i // 8, (m + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM lv WHERE m > 1 GROUP BY k, g, m, i // 8),
sub AS MATERIALIZED (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS j, count(*) OVER () AS m FROM lv WHERE m = 1),
tp(k, i, m, d) AS (
  SELECT CAST(0 AS BIGINT), j, m, d FROM sub
  UNION ALL SELECT k + 1, i // 8, (m + 7) // 8, sha256(string_agg(d, '' ORDER BY i)) FROM tp WHERE m > 1 GROUP BY k, m, i // 8),
own AS MATERIALIZED (SELECT f.doc_id, f.lang, f.i, f.leaf, f.changed, sub.d AS subroot, sub.j FROM f JOIN sub ON f.lang IS NOT DISTINCT FROM sub.g),
near AS (
  SELECT own.lang, own.i, n.k, n.i AS pos, n.d, own.i // CAST(pow(8, n.k) AS BIGINT) AS self FROM own JOIN lv n ON n.g IS NOT DISTINCT FROM own.lang AND n.m > 1 AND n.i // 8 = own.i // CAST(pow(8, n.k + 1) AS BIGINT)
  UNION ALL SELECT own.lang, own.i, n.k + 1000 AS k, n.i AS pos, n.d, own.j // CAST(pow(8, n.k) AS BIGINT) AS self FROM own JOIN tp n ON n.m > 1 AND n.i // 8 = own.j // CAST(pow(8, n.k + 1) AS BIGINT)),
sib AS MATERIALIZED (
  SELECT lang, i, row_number() OVER (PARTITION BY lang, i ORDER BY k) AS s, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos < self), '') AS l, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos > self), '') AS r FROM near GROUP BY lang, i, k),
fd(lang, i, s, d) AS (
  SELECT lang, i, CAST(0 AS BIGINT), coalesce(changed, leaf) FROM own
  UNION ALL SELECT fd.lang, fd.i, sib.s, sha256(l || fd.d || r) FROM fd JOIN sib ON sib.lang IS NOT DISTINCT FROM fd.lang AND sib.i = fd.i AND sib.s = fd.s + 1),
folded AS (SELECT lang, i, arg_max(d, s) AS d FROM fd GROUP BY lang, i),
proof AS (SELECT lang, i, string_agg(l || r, '' ORDER BY s) AS p FROM sib GROUP BY lang, i)
SELECT own.doc_id, own.leaf, own.subroot, tp.d AS root, sha256(coalesce(proof.p, '')) AS proof_sha256, folded.d AS folded_root, folded.d = tp.d AS verified
FROM own JOIN (SELECT d FROM tp WHERE m = 1) tp ON true JOIN folded ON folded.lang IS NOT DISTINCT FROM own.lang AND folded.i = own.i LEFT JOIN proof ON proof.lang IS NOT DISTINCT FROM own.lang AND proof.i = own.i
"""


def text_of(digest: Column) -> Column:
    """Digests as the lowercase hex text that is hashed and shown."""
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, a colon and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return hashed(F.concat(*parts))


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    up = lambda own, s: F.sha2(F.concat(text_of(s["left"]), own, text_of(s["right"])), 256)
    return F.unhex(F.aggregate(proof, text_of(start), up))


def proof_digest(proof: Column) -> Column:
    """SHA-256, as text, of all siblings of a proof, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: text_of(F.concat(s["left"], s["right"]))), ""), 256)


@dataclass
class Manifest:
    """Written levels, leaves first: (g, i, m, digest, children and, in the first, what
    leaves carry), of the groups' trees and of the tree above their roots."""

    levels: list[DataFrame]
    upper: list[DataFrame]
    fanout: int
    root: bytes | None

    def proofs(self) -> DataFrame:
        """Leaves with ``subroot`` and ``proof``: array<struct<left, right>>, the siblings
        on both sides, as digests in a row, from the leaf's level up to the root."""
        none = F.array().cast("array<struct<left:binary,right:binary>>")
        top = _pushed(self.upper, self.fanout, lambda rows: rows.withColumn("proof", none))
        top = top.select(F.col("key").alias("g"), F.col("digest").alias("subroot"), "proof")
        return _pushed(self.levels, self.fanout, lambda rows: rows.join(top, "g"))


def build(leaves: DataFrame, fanout: int = FANOUT) -> Manifest:
    """The manifest of leaves (g, key, digest, ...): ``g`` names the group, ``key`` gives
    the order inside it; more columns are carried along. Each level is a table in the
    shared folder."""
    if fanout < 2:
        raise ValueError("a parent needs two children at least")
    group = F.coalesce(F.concat(F.lit("1"), F.col("g").cast("string")), F.lit("0"))  # null first, then bytewise
    levels = _levels(_ranked(leaves.withColumn("g", group)), fanout)
    roots = None
    for level in levels:
        done = level.filter("m = 1").select(F.lit("").alias("g"), F.col("g").alias("key"), "digest")
        roots = done if roots is None else roots.union(done)
    upper = _levels(_ranked(roots), fanout)
    last = upper[-1].select("digest").first()
    return Manifest(levels, upper, fanout, bytes(last["digest"]) if last else None)


def _ranked(rows: DataFrame) -> DataFrame:
    """Rows with their rank ``i`` in their group and the group's size ``m``, written down:
    ranges of the order are sorted, and each gets the counts of those before it."""
    order = ["g", "key", "digest"]
    slim = materialise(rows, "leaves")
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = materialise(dealt.withColumn("row", F.monotonically_increasing_id()), "ranges")
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    own = dealt.groupBy("g", "part").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    earlier = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    skipped = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    parts = materialise(own.select("g", "part", skipped.alias("shift"), F.sum("n").over(Window.partitionBy("g")).alias("m")), "parts")
    out = dealt.join(parts, ["g", "part"]).withColumn("i", F.col("row") + F.col("shift"))
    out = materialise(out.drop("part", "row", "shift"), "level")
    discard(slim, dealt, parts)
    return out


def _levels(level: DataFrame, fanout: int) -> list[DataFrame]:
    """All levels above one, until no group has more than a node."""
    levels, most = [level], level.agg(F.max("m")).first()[0] or 0
    while most > 1:
        up = F.expr(f"i div {fanout}").alias("i")
        kids = F.sort_array(F.collect_list(F.struct(F.col("i").alias("at"), "digest")))
        found = levels[-1].filter("m > 1").groupBy("g", up).agg(kids.alias("kids"), F.max("m").alias("m"))
        children = F.unhex(F.array_join(F.transform("kids", lambda x: F.hex(x["digest"])), ""))
        found = found.select("g", "i", F.expr(f"(m + {fanout - 1}) div {fanout}").alias("m"), children.alias("children"))
        levels.append(materialise(found.withColumn("digest", hashed(text_of(F.col("children")))), "level"))
        most = -(-most // fanout)
    return levels


def _pushed(levels: list[DataFrame], fanout: int, start) -> DataFrame:
    """The lowest level with what its nodes inherit. ``start`` gives the highest nodes of
    the groups (a row each) what comes from above: ``proof`` and other columns."""
    known = start(levels[-1].filter("m = 1"))
    for level in reversed(levels[:-1]):
        above = known.select("g", F.col("i").alias("above"), F.col("children").alias("run"), *[c for c in known.columns if c not in level.columns and c != "children"])
        below = level.filter("m > 1").withColumn("above", F.expr(f"i div {fanout}")).join(above, ["g", "above"])
        at = F.expr(f"i % {fanout}").cast("int") * SIZE
        sides = F.struct(F.substring("run", F.lit(1), at).alias("left"), F.substring("run", at + SIZE + 1, F.lit(fanout * SIZE)).alias("right"))
        below = below.withColumn("proof", F.concat(F.array(sides), "proof")).drop("above", "run")
        known = below.unionByName(start(level.filter("m = 1")))
    return known


def row_leaves(docs: DataFrame, columns: Sequence[str] = COLUMNS, group: str = "lang", key: str = "doc_id", changed: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(g, key, digest) of a table's rows; with ``changed`` also the digest ``other`` of
    rows whose columns are replaced so, ``where`` that applies (else null)."""
    out = [F.col(group).alias("g"), F.col(key).alias("key"), leaf([F.col(c) for c in columns]).alias("digest")]
    if changed:
        out.append(F.when(where, leaf([changed.get(c, F.col(c)) for c in columns])).alias("other"))
    return docs.select(*out)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", _UPPER, _LOWER)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    made = build(row_leaves(docs, changed={"text": lower}, where=hit))
    root = F.lit(made.root).cast("binary")
    rows = made.proofs().withColumn("folded", fold(F.coalesce("other", "digest"), F.col("proof")))
    return rows.select(
        F.col("key").alias("doc_id"),
        text_of(F.col("digest")).alias("leaf"),
        text_of(F.col("subroot")).alias("subroot"),
        text_of(root).alias("root"),
        proof_digest(F.col("proof")).alias("proof_sha256"),
        text_of(F.col("folded")).alias("folded_root"),
        (F.col("folded") == root).alias("verified"),
    )
