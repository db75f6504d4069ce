"""Queries of sections 2.D, 2.I and 2.K: lines, dedup, packing, names, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.operators import bpe, dedup, lines, packing, recurrences, synthesis
from loomtext.plans.registry import query
from loomtext.sources.tables import table

_LINES_SQL = "(SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS w FROM documents)"
_HEADER = r"(NOT regexp_matches(trim({x}), '[,;]$') AND length(trim({x})) - length(replace(trim({x}), ',', '')) < 3 AND length(trim({x})) < 80 AND CASE WHEN regexp_matches(trim({x}), '\p{Lu}') AND upper(trim({x})) = trim({x}) THEN NOT contains({x}, ',') ELSE regexp_matches(trim({x}), '^\p{Lu}') AND length(trim({x})) < 20 AND NOT regexp_matches(trim({x}), '[.!?]$') END)"
_LABEL = r"(strpos(trim({x}), ':') BETWEEN 1 AND 30 AND len(regexp_extract_all(split_part(trim({x}), ':', 1), '\S+')) <= 3 AND regexp_matches(trim(split_part(trim({x}), ':', 1)), '^\p{Lu}'))"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "w"))


@query("D1_section_header", f"SELECT doc_id, pos, {_HEADER.replace('{x}', 'w')} AS header FROM {_LINES_SQL}")
def section_header(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", lines.is_section_header(F.col("w")).alias("header"))


_D2 = "replace(w, ' ', CASE WHEN pos % 2 = 0 THEN ': ' ELSE ' ' END)"


@query("D2_field_label", f"SELECT doc_id, pos, {_LABEL.replace('{x}', 'w')} AS label FROM (SELECT doc_id, pos, {_D2} AS w FROM {_LINES_SQL})")
def field_label(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("w", F.expr(_D2))
    return rows.select("doc_id", "pos", lines.starts_with_label(F.col("w")).alias("label"))


_VERSE = "CASE WHEN flat THEN regexp_matches(w, '^[ \t]') AND (coalesce(b <> '' AND abs((length(w) - length(ltrim(w))) - (length(b) - length(ltrim(b)))) > 2, false) OR coalesce(n <> '' AND abs((length(w) - length(ltrim(w))) - (length(n) - length(ltrim(n)))) > 2, false)) ELSE regexp_matches(w, '^[ \t]') OR (length(trim(w)) < 60 AND coalesce(n <> '' AND length(trim(n)) < 60, false)) END"


@query(
    "D3_poetry",
    f"SELECT doc_id, pos, {_VERSE} AS poetry FROM (SELECT doc_id, pos, w, lag(w) OVER d AS b, lead(w) OVER d AS n, coalesce(bool_and(CASE WHEN trim(w) <> '' THEN regexp_matches(w, '^[ \t]') END) OVER (PARTITION BY doc_id), false) AS flat FROM (SELECT doc_id, pos, repeat(' ', CAST(pos * (doc_id % 4) % 5 AS INT)) || w AS w FROM {_LINES_SQL}) WINDOW d AS (PARTITION BY doc_id ORDER BY pos))",
)
def poetry(spark, sf_dir):
    from pyspark.sql import Window

    rows = _lines(spark, sf_dir).withColumn("w", F.expr("concat(repeat(' ', cast(pos * (doc_id % 4) % 5 AS int)), w)"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    flat = F.coalesce(F.bool_and(F.when(F.trim("w") != "", F.col("w").rlike("^[ \t]"))).over(Window.partitionBy("doc_id")), F.lit(False))
    rows = rows.select("doc_id", "pos", "w", F.lag("w").over(w).alias("b"), F.lead("w").over(w).alias("n"), flat.alias("flat"))
    return rows.select("doc_id", "pos", lines.is_poetry(F.col("w"), F.col("n"), F.col("b"), F.col("flat")).alias("poetry"))


_JOIN = f"NOT ((trim(w) = '' AND trim(n) = '') OR starts_with(trim(n), '@') OR {_HEADER.replace('{x}', 'n')} OR ends_with(trim(w), ':') OR contains(n, ':') OR {_LABEL.replace('{x}', 'n')}) AND (regexp_matches(trim(w), '\\p{{Ll}}$') OR regexp_matches(trim(w), '[;,]$') OR (length(trim(w)) > 35 AND NOT regexp_matches(trim(w), '[.!?:\"''>}}\\])]$')) OR (ends_with(trim(w), ')') AND length(trim(w)) > 30))"


@query("D4_should_join", f"SELECT doc_id, pos, {_JOIN} AS joins FROM (SELECT doc_id, pos, w, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM {_LINES_SQL}) WHERE n IS NOT NULL")
def should_join(spark, sf_dir):
    from pyspark.sql import Window

    rows = _lines(spark, sf_dir).withColumn("n", F.lead("w").over(Window.partitionBy("doc_id").orderBy("pos"))).filter("n IS NOT NULL")
    return rows.select("doc_id", "pos", lines.should_join(F.col("w"), F.col("n")).alias("joins"))


def joined_sql(texts: str) -> str:
    """The fold of D5 over (doc_id, text): lines in order, each with the size of what it ends."""
    open_ = "NOT regexp_matches(s, '[.!?:\"''>}\\])]$')"
    return f"""WITH RECURSIVE t AS MATERIALIZED ({texts}),
    l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS w FROM t),
    n AS (SELECT doc_id, pos, w, trim(w) AS s, lead(w) OVER d AS n, lag(w) OVER d AS b, coalesce(bool_and(CASE WHEN trim(w) <> '' THEN regexp_matches(w, '^[ \t]') END) OVER (PARTITION BY doc_id), false) AS flat FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
    k AS MATERIALIZED (SELECT doc_id, pos, w, length(s) AS size, starts_with(s, '@') OR {_HEADER.replace('{x}', 'w')} OR contains(s, ':') AS alone,
      CASE WHEN regexp_matches(s, '[\\p{{Ll}},;]$') THEN 0 WHEN ends_with(s, ')') THEN 31 WHEN {open_} THEN 36 ELSE 1000000000 END AS least,
      s = '' OR {_VERSE} AS kept FROM n),
    f AS (SELECT doc_id, pos, CAST(size AS BIGINT) AS total, kept, least, CAST(0 AS BIGINT) AS first FROM k WHERE pos = 0
      UNION ALL SELECT k.doc_id, k.pos, CASE WHEN j THEN f.total + 1 + k.size ELSE k.size END, CASE WHEN j THEN f.kept ELSE k.kept END, k.least, CASE WHEN j THEN f.first ELSE k.pos END
      FROM f JOIN k ON k.doc_id = f.doc_id AND k.pos = f.pos + 1, LATERAL (SELECT NOT f.kept AND k.size > 0 AND NOT k.alone AND f.total >= f.least AS j)),
    g AS (SELECT f.doc_id, f.first, CASE WHEN count(*) = 1 THEN any_value(k.w) ELSE string_agg(CASE WHEN f.pos = f.first THEN rtrim(k.w) WHEN f.pos = m.last THEN ltrim(k.w) ELSE trim(k.w) END, ' ' ORDER BY f.pos) END AS w
      FROM f JOIN k ON k.doc_id = f.doc_id AND k.pos = f.pos JOIN (SELECT doc_id, first, max(pos) AS last FROM f GROUP BY ALL) m ON m.doc_id = f.doc_id AND m.first = f.first GROUP BY f.doc_id, f.first)
    SELECT doc_id, string_agg(w, chr(10) ORDER BY first) AS text FROM g GROUP BY doc_id"""


@query("D5_join_wrapped_lines", joined_sql("SELECT doc_id, text FROM documents"))
def join_wrapped(spark, sf_dir):
    return lines.joined(table(spark, sf_dir, "documents"))


def _ordered(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")


@query(
    "K1_precise_windows",
    """WITH w AS (SELECT ord, p, hash(substring(text, CAST(p + 1 AS INT), 100)) AS h FROM (SELECT doc_id AS ord, text, unnest(range(greatest(length(text) - 99, 1))) AS p FROM documents)),
    f AS (SELECT min(struct_pack(o := ord, p := p)) AS e FROM w GROUP BY h),
    k AS (SELECT e.o AS ord, e.p AS p, coalesce(lag(e.p) OVER (PARTITION BY e.o ORDER BY e.p) + 100, 0) AS done FROM f),
    s AS (SELECT ord, string_agg(substring(text, CAST(greatest(p, done) + 1 AS INT), CAST(p + 100 - greatest(p, done) AS INT)), '' ORDER BY p) AS kept, max(p) + 100 AS ending FROM k JOIN (SELECT doc_id AS ord, text FROM documents) USING (ord) GROUP BY ord)
    SELECT d.doc_id AS ord, CASE WHEN s.ord IS NULL THEN left(text, 100) WHEN length(text) - ending > 10 THEN kept || substring(text, CAST(ending + 1 AS INT)) ELSE kept END AS text FROM documents d LEFT JOIN s ON s.ord = d.doc_id""",
)
def precise(spark, sf_dir):
    return dedup.precise(_ordered(spark, sf_dir))


@query("K2_greedy_entries")
def greedy(spark, sf_dir):
    return dedup.greedy(_ordered(spark, sf_dir))


def _ids(spark, sf_dir):
    words = F.transform(F.split("text", " "), lambda w: F.length(w) + 1)
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("ids"))


_IDS_SQL = "(SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) + 1) AS ids FROM documents)"


def _packed_sql(length, stride, inclusive, least):
    end = f"len(ids) - {length}" + (" + 1" if inclusive else "")
    return f"""
    SELECT doc_id, CAST(s // {stride} AS INT) AS seq_no, array_to_string(ids[s + 1:s + {length}], ' ') AS ids FROM (SELECT doc_id, ids, unnest(range(0, greatest(0, {end}), {stride})) AS s FROM {_IDS_SQL} WHERE NOT (len(ids) > {least} AND len(ids) < {length}))
    UNION ALL SELECT doc_id, 0 AS seq_no, array_to_string(list_concat(ids, list_transform(range({length} - len(ids)), lambda x: 0)), ' ') AS ids FROM {_IDS_SQL} WHERE len(ids) > {least} AND len(ids) < {length}"""


def _text(df):
    return df.select("doc_id", F.col("seq_no").cast("int").alias("seq_no"), F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("K9_pack", _packed_sql(64, 32, False, 64 / 20 + 3))
def pack(spark, sf_dir):
    return _text(packing.pack(_ids(spark, sf_dir), 64))


@query("K10_pack_inclusive", _packed_sql(65, 128, True, 1e9))
def pack_inclusive(spark, sf_dir):
    return _text(packing.pack(_ids(spark, sf_dir), 65, 128, inclusive=True, least=1e9))


@query("K11_shift_and_mask", f"SELECT doc_id, array_to_string(ids[1:len(ids) - 1], ' ') AS x, array_to_string(ids[2:len(ids)], ' ') AS y, CAST(len(list_filter(ids[1:len(ids) - 1], lambda t: t <> 1)) AS INT) AS unmasked FROM {_IDS_SQL}")
def shift_and_mask(spark, sf_dir):
    s = packing.shifted(F.col("ids"), 1)
    text = lambda c: F.array_join(c.cast("array<string>"), " ")
    return _ids(spark, sf_dir).select("doc_id", s.alias("s")).select("doc_id", text(F.col("s.x")).alias("x"), text(F.col("s.y")).alias("y"), F.size(F.filter("s.mask", lambda m: m)).alias("unmasked"))


@query("K12_pad_batches", f"SELECT batch, seq_no, array_to_string(list_concat(ids, list_transform(range(longest - len(ids)), lambda x: 0)), ' ') AS ids FROM (SELECT doc_id AS seq_no, doc_id // 8 AS batch, ids, max(len(ids)) OVER (PARTITION BY doc_id // 8) AS longest FROM {_IDS_SQL})")
def pad_batches(spark, sf_dir):
    seqs = _ids(spark, sf_dir).select(F.col("doc_id").alias("seq_no"), "ids")
    return packing.batches(seqs, 8).select("batch", "seq_no", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("I5_seeded_split", "SELECT doc_id, row_number() OVER (ORDER BY CAST('0x' || left(md5('42:' || doc_id), 15) AS BIGINT), doc_id) <= floor(count(*) OVER () * 0.95) AS train FROM documents")
def seeded_split(spark, sf_dir):
    return packing.split(table(spark, sf_dir, "documents").select("doc_id"), 0.95, 42)


@query("K4_bpe_train")
def bpe_train(spark, sf_dir):
    return bpe.train(table(spark, sf_dir, "documents").select("doc_id", "text"), 400)


@query("K5_bpe_train_to_compression")
def bpe_train_compression(spark, sf_dir):
    return bpe.train(table(spark, sf_dir, "documents").select("doc_id", "text"), 50_000, target=0.5, min_frequency=2, min_gain=0.001)


@query("K6_bpe_encode")
def bpe_encode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, bpe.train(docs, 400))


@query("K7_bpe_decode", "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS text FROM documents")
def bpe_decode(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    merges = bpe.train(docs, 400)
    return bpe.decode(bpe.encode(docs, merges))


_NAMES_SQL = "(SELECT c_mktsegment AS category, c_custkey AS line_no, c_name || ' ' || c_custkey % 7 || ' x' || c_custkey % 3 AS name FROM customer)"


@query(
    "K13_name_pairs",
    f"""WITH p AS (SELECT category, line_no, name, string_split(name, ' ') AS t FROM {_NAMES_SQL}),
    e AS (SELECT category, line_no, unnest(v) AS token, unnest(range(len(v))) AS pos FROM (SELECT category, line_no, list_concat(t, CASE WHEN len(t) IN (3, 4) AND NOT contains(name, '(') THEN [t[1] || ' ' || t[-1]] ELSE [] END, [name]) AS v FROM p)),
    u AS (SELECT category, token, row_number() OVER (PARTITION BY category, token ORDER BY line_no, pos) AS rn, line_no FROM e)
    SELECT category, line_no, '<BOS>' || category || '<RESP>' || token || '<EOS>' AS ask, '<BOS>' || token || '<RESP>' || category || '<EOS>' AS answer FROM u WHERE rn = 1""",
)
def name_pairs(spark, sf_dir):
    from loomtext.operators import names

    rows = table(spark, sf_dir, "customer").selectExpr("c_mktsegment AS category", "c_custkey AS line_no", "concat(c_name, ' ', c_custkey % 7, ' x', c_custkey % 3) AS name")
    return names.pairs(rows)


@query("K14_class_fold", "SELECT category, CASE WHEN n < 300 THEN '<folder-Misc>' ELSE '<' || category || '>' END AS class, n, n >= 300 OR category = max(CASE WHEN n < 300 THEN category END) OVER () AS held_out FROM (SELECT c_mktsegment AS category, count(*) AS n FROM customer GROUP BY c_mktsegment)")
def class_fold(spark, sf_dir):
    from loomtext.operators import names

    return names.fold(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category")), 300)


_PICKS = {
    "op": "p_size", "size": "p_partkey", "form": "p_partkey * 3 + p_size", "kind": "p_partkey + 2 * p_size", "opener": "p_partkey * 5 + p_size", "phrase": "p_partkey * 7 + p_size",
    "swap": "p_partkey * 11 + p_size * 3", "answer": "p_partkey * 13 + p_size", "sign": "p_partkey * 17 + p_size * 5", "x": "p_partkey * 7919 + p_size * 104729", "y": "p_partkey * 31337 + p_size * 17",
}


def _arithmetic_sql() -> str:
    """The grammar's tables as values, expanded by joins on the same numbers."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    listed = lambda vs: "[" + ", ".join(map(quoted, vs)) + "]"
    forms = ", ".join(f"({i}, {quoted(f.text)}, {listed(f.kinds)}, {quoted(f.ends)})" for i, f in enumerate(synthesis.FORMS))
    groups: dict[tuple, list] = {}
    for q in synthesis.PHRASES:
        groups.setdefault((q.op, q.kind), []).append(q)
    phrases = ", ".join(f"({quoted(q.op)}, {quoted(q.kind)}, {i}, {len(g)}, {quoted(q.text)}, {q.ordered})" for g in groups.values() for i, q in enumerate(g))
    signs = ", ".join(f"({quoted(op)}, {listed(v)})" for op, v in synthesis.SIGNS.items())
    pick = lambda values, at: f"{listed(values)}[{at} % {len(values)} + 1]"
    return f"""WITH forms(fi, ftext, kinds, ends) AS (VALUES {forms}), phrases(o, own, pi, n, ptext, ordered) AS (VALUES {phrases}), signs(o, marks) AS (VALUES {signs}),
    c AS (SELECT p_partkey AS id, {', '.join(f'CAST({v} AS BIGINT) AS {k}' for k, v in _PICKS.items())} FROM part),
    k AS (SELECT *, {pick(synthesis.OPS, 'op')} AS o, {list(synthesis.MAGNITUDES)}[size % {len(synthesis.MAGNITUDES)} + 1] AS top, kinds[kind % len(kinds) + 1] AS own FROM c JOIN forms ON fi = form % {len(synthesis.FORMS)}),
    z AS (SELECT *, x % (2 * top + 1) - top AS a0, CASE WHEN o = 'DIVIDE' AND y % (2 * top + 1) - top = 0 THEN 1 ELSE y % (2 * top + 1) - top END AS b0 FROM k),
    q AS (SELECT z.*, ptext, marks, swap % 2 = 1 AND z.own <> '{synthesis.TASK}' AND NOT ordered AS turned, CASE WHEN z.o = 'DIVIDE' THEN a0 * b0 ELSE a0 END AS a1 FROM z JOIN phrases p ON p.o = z.o AND p.own = z.own AND p.pi = phrase % n JOIN signs g ON g.o = z.o),
    t AS (SELECT *, CASE WHEN turned THEN b0 ELSE a1 END AS a, CASE WHEN turned THEN a1 ELSE b0 END AS b FROM q),
    r AS (SELECT *, CASE o WHEN 'ADD' THEN a + b WHEN 'SUBTRACT' THEN a - b WHEN 'MULTIPLY' THEN a * b ELSE CASE WHEN b <> 0 THEN a // b - CASE WHEN a % b <> 0 AND (a < 0) <> (b < 0) THEN 1 ELSE 0 END END END AS result,
      replace(replace(replace(replace(ftext, '{{o}}', {pick(synthesis.OPENERS, 'opener')}), '{{p}}', ptext), '{{a}}', CAST(a AS VARCHAR)), '{{b}}', CAST(b AS VARCHAR)) AS question FROM t)
    SELECT id, o AS op, a, b, result, question || CASE WHEN right(question, 1) IN ('.', '?', '!') THEN '' ELSE ends END AS question,
      replace(replace(replace(replace({pick(synthesis.ANSWERS, 'answer')}, '{{s}}', marks[sign % len(marks) + 1]), '{{r}}', coalesce(CAST(result AS VARCHAR), 'undefined')), '{{a}}', CAST(a AS VARCHAR)), '{{b}}', CAST(b AS VARCHAR)) AS answer FROM r"""


@query("K15_arithmetic_pairs", _arithmetic_sql())
def arithmetic(spark, sf_dir):
    return synthesis.arithmetic(table(spark, sf_dir, "part").selectExpr("p_partkey AS id", *[f"CAST({v} AS BIGINT) AS {k}" for k, v in _PICKS.items()]))


_RUN = "SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value FROM events"


def _recursive(first: str, then: str) -> str:
    return f"WITH RECURSIVE l AS ({_RUN}), r AS (SELECT run, step, {first} FROM l WHERE step = 1 UNION ALL SELECT l.run, l.step, {then} FROM r JOIN l ON l.run = r.run AND l.step = r.step + 1)"


def _series(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "ts", "event_id", "value")


_ORDER = ["ts", "event_id"]


@query("H10_ema", _recursive("value AS m", "0.9 * r.m + 0.1 * l.value AS m") + " SELECT run, step, round(m, 6) AS m FROM r")
def ema(spark, sf_dir):
    return recurrences.ema(_series(spark, sf_dir), _ORDER, 0.1).select("run", "step", F.round("out", 6).alias("m"))


@query("H12_leaky_integration", _recursive("0.1 * value AS u", "0.9 * r.u + 0.1 * l.value AS u") + " SELECT run, step, round(u, 6) AS u FROM r")
def leaky(spark, sf_dir):
    return recurrences.leaky(_series(spark, sf_dir), _ORDER, 0.1).select("run", "step", F.round("out", 6).alias("u"))


@query("H11_spikes", _recursive("CASE WHEN value >= 100 THEN 0 ELSE value END AS v, value >= 100 AS spike", "CASE WHEN 0.8 * r.v + l.value >= 100 THEN 0 ELSE 0.8 * r.v + l.value END AS v, 0.8 * r.v + l.value >= 100 AS spike") + " SELECT run, step, spike FROM r")
def spikes(spark, sf_dir):
    return recurrences.spikes(_series(spark, sf_dir), _ORDER, 0.2, 100.0).withColumnRenamed("out", "spike")


@query("L_fake_quantise", "SELECT vec_id, round(sum(greatest(-127, least(127, round_even(v / s, 0))) * s), 6) AS total FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, (SELECT greatest(max(abs(CAST(x AS DOUBLE))), 1e-8) / 127 FROM (SELECT unnest(embedding) AS x FROM embeddings)) AS s FROM embeddings) GROUP BY vec_id")
def fake_quantise(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    scale = v.agg((F.greatest(F.max(F.abs("v")), F.lit(1e-8)) / 127).alias("s"))
    q = recurrences.fake_quantise(F.col("v"), F.col("s"))
    return v.crossJoin(F.broadcast(scale)).groupBy("vec_id").agg(F.round(F.sum(q), 6).alias("total"))
