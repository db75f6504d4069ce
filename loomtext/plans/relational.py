"""Queries of sections 2.A and 2.E-2.J that plain SQL states: filters, joins,
aggregations, windows, sorts and sets.

A statement is written once where both engines read it; what they spell
differently (exploding arrays, above all) stands in DIALECT under a name.
"""

from __future__ import annotations

import re

from loomtext.plans.registry import query
from loomtext.sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The least words of each bucket of text lengths, and how many texts are taken of the first 14.
MARKERS = (0, 200, 1000, 5000, 10000, 20000, 40000, 60000, 80000, 100000, 150000, 200000, 300000, 500000, 1000000)
QUOTAS = (0, 0, 10000, 5000, 2500, 1000, 100, 50, 40, 30, 20, 10, 8, 4)

#: name: (Spark, DuckDB)
DIALECT = {
    "WORDS": ("SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(split(text, ' ')) AS pos, w", "SELECT doc_id, unnest(range(len(string_split(text, ' ')))) AS pos, unnest(string_split(text, ' ')) AS w FROM documents"),
    "LINES": ("SELECT doc_id, pos, w FROM documents LATERAL VIEW posexplode(split(text, '\\n')) AS pos, w", "SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS w FROM documents"),
    "NAMES": ("SELECT p_type, p_partkey, pos, w FROM part LATERAL VIEW posexplode(split(p_name, ' ')) AS pos, w", "SELECT p_type, p_partkey, unnest(range(len(string_split(p_name, ' ')))) AS pos, unnest(string_split(p_name, ' ')) AS w FROM part"),
    "VECTOR": ("SELECT vec_id, label, pos, CAST(v AS DOUBLE) AS v FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, v", "SELECT vec_id, label, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings"),
    "GRAMS": (
        "SELECT w, c, n, substring(w, i, n) AS gram FROM f LATERAL VIEW explode(sequence(1, 4)) AS n LATERAL VIEW explode(sequence(1, length(w))) AS i WHERE i + n - 1 <= length(w)",
        "SELECT w, c, n, substring(w, CAST(i AS INT), CAST(n AS INT)) AS gram FROM (SELECT w, c, unnest(range(1, length(w) + 1)) AS i FROM f), range(1, 5) AS a(n) WHERE i + n - 1 <= length(w)",
    ),
    "KEPT": ("", "MATERIALIZED"),
    "PLACE_TYPE": ("STRUCT<doc_id: BIGINT, pos: INT>", "STRUCT(doc_id BIGINT, pos BIGINT)"),
    "PLACE": ("struct(doc_id, pos)", "struct_pack(doc_id := doc_id, pos := pos)"),
    "SPLIT_WORDS": ("regexp_count(text, '\\\\S+')", "len(regexp_extract_all(text, '\\S+'))"),
    "MARKERS": (f"SELECT explode(array({', '.join(map(str, MARKERS))})) AS marker", f"SELECT unnest([{', '.join(map(str, MARKERS))}]) AS marker"),
    "BOUNDS": ("SELECT explode(sequence(0, 14)) AS bucket", "SELECT unnest(range(15)) AS bucket"),
    "SIZES": ("SELECT explode(array(128, 256, 512, 1024)) AS size", "SELECT unnest([128, 256, 512, 1024]) AS size"),
    "COUNT_WORDS": ("size(split(text, ' '))", "len(string_split(text, ' '))"),
    "URLS": ("SELECT page_id, pos, u FROM pages LATERAL VIEW posexplode(array(concat('https', substring(url, 5)), url, concat(url, '?')))  AS pos, u", "SELECT page_id, unnest([0, 1, 2]) AS pos, unnest(['https' || substring(url, 5), url, url || '?']) AS u FROM pages"),
    "WINDOWS": ("SELECT doc_id, p, substring(text, p * 25 + 1, 100) AS win FROM documents LATERAL VIEW explode(sequence(0, CAST(floor(greatest(length(text) - 100, 0) / 25) AS INT))) AS p", "SELECT doc_id, p, substring(text, CAST(p * 25 + 1 AS INT), 100) AS win FROM (SELECT doc_id, text, unnest(range(CAST(floor(greatest(length(text) - 100, 0) / 25) AS INT) + 1)) AS p FROM documents)"),
    "DIV": ("div", "//"),
    "CHARS": ("SELECT DISTINCT c FROM (SELECT explode(split(text, '')) AS c FROM documents) WHERE c <> ''", "SELECT DISTINCT c FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''"),
    "SENTENCES": ("SELECT doc_id, s FROM documents LATERAL VIEW explode(split(text, '[.]')) AS s", "SELECT doc_id, unnest(string_split(text, '.')) AS s FROM documents"),
    "SENTENCE_SIZE": ("size(split(s, ' '))", "len(string_split(s, ' '))"),
    "TRY_INT": ("try_cast(regexp_replace(p_name, ' .*', '') AS INT)", "try_cast(regexp_replace(p_name, ' .*', '') AS INT)"),
}

LOSS = "SELECT user_id AS run, event_type AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss FROM events"


def _fill(sql: str, side: int) -> str:
    sql = sql.replace("{LOSS}", LOSS)
    for _ in range(2):
        for k, v in DIALECT.items():
            sql = sql.replace("{" + k + "}", v[side])
    return sql


def both(name: str, sql: str) -> None:
    spark_sql, used = _fill(sql, 0), [t for t in TABLES if re.search(rf"\b{t}\b", _fill(sql, 0))]
    for t in used:
        spark_sql = re.sub(rf"\b{t}\b(?!\.)", "{" + t + "}", spark_sql)

    def run(spark, sf_dir):
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in used})

    query(name, _fill(sql, 1))(run)


# A: sources as tables
both("A8_roles_by_extension", "SELECT doc_id, CASE WHEN name LIKE '%.txt' THEN 'train' ELSE 'test' END AS role FROM (SELECT doc_id, concat('w', doc_id, CASE doc_id % 5 WHEN 0 THEN '.TEST' WHEN 1 THEN '.pdf' ELSE '.txt' END) AS name FROM documents) WHERE name LIKE '%.txt' OR name LIKE '%.TEST' ORDER BY doc_id LIMIT 600")
both("A11_lines", "{LINES}")
both("A16_url_fallback", "SELECT c.page_id, min(c.pos) AS tried, min(p.url) AS url FROM ({URLS}) c JOIN (SELECT url FROM pages) p ON c.u = p.url GROUP BY c.page_id")
both("A17_metadata_search", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE '%1%' ORDER BY c_custkey LIMIT 3")
both("A18_ids_from_lines", "SELECT id FROM (SELECT try_cast(CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE concat('', c_custkey) END AS INT) AS id FROM customer) WHERE id IS NOT NULL")
both("A19_preset_tokens", "WITH allowed AS {KEPT} (SELECT lower(w) AS token, min({PLACE}) AS ord FROM ({WORDS}) WHERE w <> '' AND lower(w) NOT IN ('the', 'and', 'of') GROUP BY lower(w)), forms AS (SELECT token, ord AS own, CAST(NULL AS {PLACE_TYPE}) AS marked FROM allowed UNION ALL SELECT substring(token, 1, length(token) - 1) AS token, CAST(NULL AS {PLACE_TYPE}) AS own, ord AS marked FROM allowed WHERE right(token, 1) = '_') SELECT token FROM (SELECT token, min(own) AS own, min(marked) AS marked FROM forms GROUP BY token) WHERE own IS NOT NULL AND (marked IS NULL OR marked >= own)")

# E: filters
both("E1_extension", "SELECT doc_id FROM (SELECT doc_id, concat('w', doc_id, CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' ELSE '.IGNORE' END) AS name FROM documents) WHERE name LIKE '%.txt' OR name LIKE '%.html'")
both("E2_language_gate", "SELECT doc_id, CASE WHEN lower(lang) = 'en' THEN '.txt' ELSE '.IGNORE' END AS ext FROM documents")
both("E3_media_gate", "SELECT event_id, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
both("E4_length_band", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) > 200 AND length(text) < 5000 AND {COUNT_WORDS} > 512 / 20.0 + 3")
both("E5_chunks", "SELECT doc_id, pos, trim(w) AS chunk FROM ({LINES}) WHERE length(trim(w)) > 0")
both("E6_nonzero", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey HAVING count(o_orderkey) > 0")
both("E7_rare_presets", "WITH words AS ({WORDS}), f AS (SELECT lower(w) AS token, count(*) AS n FROM words GROUP BY lower(w)) SELECT token, n FROM f WHERE n < 100 AND token IN (SELECT w FROM ({NAMES}) UNION SELECT 'threa')")

# F: joins
both("F1_left_anti", "SELECT d.doc_id FROM documents AS d WHERE NOT EXISTS (SELECT 1 FROM labels AS l WHERE l.doc_id = d.doc_id)")
both("F2_inner", "SELECT d.doc_id, l.quality, b.item_id FROM documents d JOIN labels l ON l.doc_id = d.doc_id JOIN benchmark b ON b.item_id = d.doc_id".replace(" d JOIN", " AS d JOIN").replace("labels l", "labels AS l").replace("benchmark b", "benchmark AS b"))
both("F4_zero_fill", "WITH words AS ({WORDS}), c AS (SELECT lower(w) AS token, count(*) AS n FROM words GROUP BY lower(w)), v AS (SELECT DISTINCT w AS token FROM ({NAMES}) UNION SELECT 'the' AS token) SELECT v.token, coalesce(c.n, 0) AS n FROM v LEFT JOIN c ON c.token = v.token")
both("F7_forward_as_of", "WITH l AS ({LOSS}) SELECT run, step, loss, min_step AS eval_step FROM (SELECT run, step, loss, min(CASE WHEN step % 10 = 0 THEN step END) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS min_step FROM l)")
both("F8_bucket_quota", "WITH q AS (SELECT 0 AS bucket, 3 AS quota UNION ALL SELECT 1 AS bucket, 2 AS quota UNION ALL SELECT 2 AS bucket, 1 AS quota), b AS (SELECT doc_id, CASE WHEN length(text) < 1000 THEN 0 WHEN length(text) < 3000 THEN 1 ELSE 2 END AS bucket FROM documents) SELECT b.doc_id, b.bucket, q.quota FROM b JOIN q ON q.bucket = b.bucket")
both("F9_first_holder", "SELECT doc_id, id, first_value(doc_id) OVER (PARTITION BY id ORDER BY doc_id) AS holder FROM (SELECT doc_id, doc_id % 90 AS id FROM documents)")

# G: aggregations
both("G1_totals", "SELECT count(*) AS works, CAST(sum({COUNT_WORDS}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents")
both("G4_word_frequency", "SELECT token, count(*) AS n FROM (SELECT CASE WHEN pos = 0 THEN w ELSE concat('Ġ', w) END AS token FROM ({WORDS}) WHERE w <> '') GROUP BY token")
both("G5_ngrams", "WITH words AS ({WORDS}), f AS (SELECT w, count(*) AS c FROM words WHERE w <> '' GROUP BY w), g AS ({GRAMS}) SELECT gram, n, c FROM (SELECT gram, n, CAST(sum(c) AS BIGINT) AS c FROM g GROUP BY gram, n HAVING sum(c) >= 2) ORDER BY c DESC, n, gram LIMIT 1000")
both("G8_longest_sentence", "SELECT max({SENTENCE_SIZE}) AS longest FROM ({SENTENCES})")
_BUCKET = "CASE WHEN n < 100 THEN 0 WHEN n < 500 THEN 1 WHEN n < 1000 THEN 2 WHEN n < 5000 THEN 3 WHEN n < 10000 THEN 4 WHEN n < 50000 THEN 5 WHEN n < 100000 THEN 6 WHEN n < 500000 THEN 7 WHEN n < 1000000 THEN 8 WHEN n < 2000000 THEN 9 WHEN n < 5000000 THEN 10 WHEN n < 10000000 THEN 11 WHEN n < 20000000 THEN 12 WHEN n < 30000000 THEN 13 ELSE 14 END"
both("G10_frequency_histogram", f"WITH words AS ({{WORDS}}), f AS (SELECT w, count(*) AS n FROM words GROUP BY w), h AS (SELECT {_BUCKET} AS bucket, count(*) AS tokens FROM f GROUP BY {_BUCKET}) SELECT b.bucket, coalesce(h.tokens, 0) AS tokens, round(1e2 * coalesce(h.tokens, 0) / (SELECT count(*) FROM f), 6) AS pct FROM ({{BOUNDS}}) b LEFT JOIN h ON h.bucket = b.bucket")
MARK = f"CASE {' '.join(f'WHEN n >= {m} THEN {m}' for m in reversed(MARKERS))} END"
#: In Spark the number is a lambda's variable: a column would be replaced by the count of
#: words that it stands for, once a branch.
DIALECT["MARK"] = (f"element_at(transform(array(n), k -> {re.sub(r'\bn\b', 'k', MARK)}), 1)", MARK)
both("G11_length_histogram", f"WITH h AS (SELECT {{MARK}} AS marker, count(*) AS works, min(doc_id) AS first_idx FROM (SELECT doc_id, {{SPLIT_WORDS}} AS n FROM documents) GROUP BY {{MARK}}) SELECT m.marker, coalesce(h.works, 0) AS works, h.first_idx FROM ({{MARKERS}}) m LEFT JOIN h ON h.marker = m.marker")
both("G12_compression_ratio", "SELECT lang, round(coalesce(CAST(sum({COUNT_WORDS}) AS DOUBLE) / nullif(sum(length(text)), 0), 1.0), 9) AS ratio FROM documents GROUP BY lang")
both("G13_pair_frequency", "WITH words AS ({WORDS}), f AS (SELECT w, count(*) AS c FROM words WHERE w <> '' GROUP BY w), g AS ({GRAMS}) SELECT gram AS pair, CAST(sum(c) AS BIGINT) AS n FROM g WHERE n = 2 GROUP BY gram")
both("G14_dedup_stats", "SELECT seen, kept, seen - kept AS removed, round(1e2 * (seen - kept) / seen, 6) AS pct FROM (SELECT count(*) AS seen, count(DISTINCT md5(text)) AS kept FROM documents)")
both("G15_macro_average", "SELECT round(avg(m), 9) AS macro FROM (SELECT event_type, avg(value) AS m FROM events GROUP BY event_type)")
both("G16_micro_average", "SELECT round(avg(value), 9) AS micro FROM (SELECT value FROM events ORDER BY event_id LIMIT 1000)")
both("G17_epoch_mean", "SELECT run, CAST(floor((step - 1) / 10) AS BIGINT) AS epoch, round(avg(loss), 9) AS loss FROM ({LOSS}) GROUP BY run, floor((step - 1) / 10)")
both("G18_top_categories", "SELECT label, round(sum(p) / max(names), 9) AS score FROM (SELECT vec_id, pos AS label, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS rn, (SELECT count(*) FROM embeddings) AS names FROM (SELECT vec_id, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM ({VECTOR}))) WHERE rn <= 10 GROUP BY label".replace("exp(v) / sum", "exp(v) / sum"))
both("G19_firing_rate", "SELECT label, count(CASE WHEN v >= 0.1 THEN 1 END) AS spikes, count(*) AS neurons, round(1e2 * count(CASE WHEN v >= 0.1 THEN 1 END) / nullif(count(*), 0), 6) AS pct FROM ({VECTOR}) GROUP BY label")
both("G20_abs_max_scale", "SELECT label, round(greatest(max(abs(v)), 1e-8) / 127.0, 9) AS scale FROM ({VECTOR}) GROUP BY label")
both("G21_l2_norm", "SELECT round(sqrt(sum(v * v)), 6) AS norm FROM ({VECTOR})")
_PACKED = "SELECT CAST(sum(CASE WHEN n > 128 THEN floor((n - 128) / 128) + 1 ELSE 0 END) AS BIGINT) AS bounded, CAST(floor((sum(n) - 128) / 128) + 1 AS BIGINT) AS contiguous, count(CASE WHEN n > 2000 THEN 1 END) AS oversized FROM (SELECT {COUNT_WORDS} AS n FROM documents)"
both("G22_packing_estimate", f"SELECT bounded, contiguous, oversized, round(1e2 * (contiguous - bounded) / nullif(contiguous, 0), 6) AS pct_reduction FROM ({_PACKED})")
both("G22_first_oversized", "SELECT doc_id, n, CAST(floor((n - 128) / 128) + 1 AS BIGINT) AS sequences FROM (SELECT doc_id, {COUNT_WORDS} AS n FROM documents) WHERE n > 2000 ORDER BY doc_id LIMIT 5")
both("G23_padding_model", "SELECT size, CAST(sum(floor(n / (size / 2.0))) AS BIGINT) AS sequences, CAST(sum(CASE WHEN n < size THEN size - n ELSE 0 END) AS BIGINT) AS padding, round(1e2 * sum(CASE WHEN n < size THEN size - n ELSE 0 END) / sum(CASE WHEN n < size THEN size ELSE n END), 6) AS pct FROM (SELECT {COUNT_WORDS} AS n FROM documents) d CROSS JOIN ({SIZES}) s GROUP BY size")
both("G25_accuracy", "SELECT round(avg(CASE WHEN label = best THEN 1e0 ELSE 0e0 END), 9) AS accuracy FROM (SELECT vec_id, label, pos % 10 AS best, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rn FROM ({VECTOR})) WHERE rn = 1")
both("G26_expert_balance", "SELECT round(sum(importance * share) * 64, 6) AS loss FROM (SELECT pos, avg(p) AS importance, avg(CASE WHEN rn = 1 THEN 1e0 ELSE 0e0 END) AS share FROM (SELECT pos, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, pos) AS rn FROM (SELECT vec_id, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM ({VECTOR}))) GROUP BY pos)")

# H: windows
both("H1_first_by_key", "SELECT doc_id, id, source, rn = 1 AS kept, holder, holder_source FROM (SELECT doc_id, source, id, row_number() OVER (PARTITION BY id ORDER BY source, doc_id) AS rn, first_value(doc_id) OVER (PARTITION BY id ORDER BY source, doc_id) AS holder, first_value(source) OVER (PARTITION BY id ORDER BY source, doc_id) AS holder_source FROM (SELECT doc_id, source, doc_id % 90 AS id FROM documents))")
_QUOTA = f"CASE marker {' '.join(f'WHEN {m} THEN {q}' for m, q in zip(MARKERS, QUOTAS))} ELSE 0 END"
both("H2_quota_sample", f"WITH b AS (SELECT doc_id, {{MARK}} AS marker FROM (SELECT doc_id, {{SPLIT_WORDS}} AS n FROM documents)) SELECT doc_id, marker FROM (SELECT doc_id, marker, row_number() OVER (PARTITION BY marker ORDER BY doc_id) AS rn FROM b) WHERE rn <= {max(QUOTAS)} AND rn <= {_QUOTA}")
both("H3_delta", "WITH l AS ({LOSS}) SELECT run, step, round(coalesce(lag(loss) OVER (PARTITION BY run ORDER BY step), last_value(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) - loss, 9) AS delta FROM l")
both("H4_perplexity", "SELECT run, step, round(exp(loss / 100.0), 6) AS perplexity FROM ({LOSS}) WHERE step > 20")
_BEST = "SELECT run, step, loss, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM l"
both(
    "H5_early_stop",
    f"WITH l AS ({{LOSS}}), b AS ({_BEST}), m AS (SELECT run, step, loss, best, CASE WHEN best IS NULL OR loss < best THEN 1 ELSE 0 END AS up FROM b), g AS (SELECT run, step, loss, best, up, sum(up) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS island, sum(1 - up) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING) AS worse FROM m), s AS (SELECT run, step, loss, best, up, worse, sum(1 - up) OVER (PARTITION BY run, island ORDER BY step ROWS UNBOUNDED PRECEDING) AS streak FROM g) SELECT run, min(step) AS stop_step FROM s WHERE up = 0 AND (loss > 1.03 * best OR streak >= 5 OR (worse >= 8 AND streak >= 2)) GROUP BY run",
)
both("H6_top_p", "SELECT vec_id, pos, round(p, 9) AS p FROM (SELECT vec_id, pos, p, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, pos ROWS UNBOUNDED PRECEDING) - p AS ahead FROM (SELECT vec_id, pos, exp(v) / sum(exp(v)) OVER (PARTITION BY vec_id) AS p FROM ({VECTOR}))) WHERE ahead <= 0.5")
both("H8_every_tenth", "SELECT run, step, loss FROM ({LOSS}) WHERE (step - 1) % 10 = 0")
both("H9_validation_split", "WITH w AS ({NAMES}), f AS (SELECT p_type, p_partkey, count(CASE WHEN first THEN 1 END) AS fresh FROM (SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type, w ORDER BY p_partkey, pos) = 1 AS first FROM w) GROUP BY p_type, p_partkey) SELECT p_type, p_partkey, coalesce(before, 0) <= greatest(3, least(0.05 * n, 4096)) AS validation FROM (SELECT p_type, p_partkey, sum(fresh) OVER (PARTITION BY p_type ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) OVER (PARTITION BY p_type) AS n FROM f)")
_DECAY = "CASE WHEN event_id < 1000 THEN event_id / 1000.0 ELSE {least} + 0.9 * 0.5 * (1 + cos(3.141592653589793 * (event_id - 1000) / 9000.0)) END"
both("H13_learning_rate", f"SELECT event_id AS step, round({_DECAY.format(least='0.1')}, 9) AS rate, round({_DECAY.format(least='0.00001')}, 9) AS rate_to_zero FROM events")

# I: sorts and limits
_FREQ = "WITH words AS ({WORDS}), f AS (SELECT w, count(*) AS n FROM words WHERE w <> '' GROUP BY w)"
both("I1_top_tokens", f"{_FREQ} SELECT w, n FROM f ORDER BY n DESC, w LIMIT 20")
both("I2_bottom_tokens", f"{_FREQ} SELECT w, n FROM f WHERE n > 0 ORDER BY n, w LIMIT 20")
both("I3_top_predictions", "SELECT vec_id, pos, rn FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, pos) AS rn FROM ({VECTOR})) WHERE rn <= 5")
both("I4_page", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 25 OFFSET 50")

# J: sets
both("J1_union_all", "SELECT doc_id AS id, text FROM documents UNION ALL SELECT item_id AS id, text FROM benchmark")
both("J2_except", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
both("J3_union", "SELECT w FROM ({WORDS}) UNION SELECT w FROM ({NAMES})")
