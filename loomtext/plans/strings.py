"""Queries of section 2.C: string projections, on texts prepared as FIXTURES says."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import repair
from loomtext.functions import text as T
from loomtext.operators import pages, prefixes
from loomtext.plans.registry import query
from loomtext.sources.tables import table

RUNS = "replace(text, '\\n', repeat('\\n', cast(1 + doc_id % 8 AS int)))"
RUNS_SQL = "replace(text, chr(10), repeat(chr(10), CAST(1 + doc_id % 8 AS INT)))"
GAPS = "replace(text, ' the ', '  the \\t ')"
GAPS_SQL = "replace(text, ' the ', '  the ' || chr(9) || ' ')"
NL = "chr(10)"


def projected(name: str, source: str, source_sql: str, f, sql: str) -> None:
    """Register ``f`` over a prepared text; ``{t}`` in ``sql`` is that text."""

    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(source).alias("text"))
        return docs.select("doc_id", f(F.col("text")).alias("out"))

    query(name, f"SELECT doc_id, {sql.replace('{t}', f'({source_sql})')} AS out FROM documents")(run)


def cascade_sql(five: int, more: int, t: str = "{t}") -> str:
    lone = r"'(^|[^\n])\n([^\n]|$)', '\1 \2', 'g'"
    out = f"regexp_replace(regexp_replace({t}, {lone}), {lone})"
    for old, new in ((2, 1), (3, 2), (4, 3), (5, five)):
        out = f"replace({out}, repeat({NL}, {old}), repeat({NL}, {new}))"
    return f"regexp_replace({out}, '\\n{{6,}}', repeat({NL}, {more}), 'g')"


def policy_sql(lengths: tuple[int, ...], t: str = "{t}") -> str:
    out = t
    for n in range(len(lengths), 0, -1):
        to = f"repeat(chr(1), {lengths[n - 1]})" if lengths[n - 1] else "' '"
        out = f"regexp_replace({out}, '\\n{{{n},{'' if n == len(lengths) else n}}}', {to}, 'g')"
    return f"replace({out}, chr(1), {NL})"


SPACES_SQL = "regexp_replace({t}, ' +', ' ', 'g')"
projected("C1_collapse_spaces", GAPS, GAPS_SQL, T.collapse_spaces, SPACES_SQL)
projected("C2_flatten_white_space", RUNS, RUNS_SQL, T.flatten_white_space, r"regexp_replace({t}, '\s', ' ', 'g')")
TABS_SQL = "replace(replace({t}, chr(9) || ' ', chr(9)), ' ' || chr(9), chr(9))"
projected("C3_tidy_tabs", GAPS, GAPS_SQL, T.tidy_tabs, TABS_SQL)
projected("C4_newline_cascade", RUNS, RUNS_SQL, T.newline_cascade, cascade_sql(4, 5))
projected("C5_newline_cascade_short", RUNS, RUNS_SQL, lambda t: T.newline_cascade(t, 3, 3), cascade_sql(3, 3))
for _id, _lengths in T.NEWLINE_POLICIES.items():
    projected(f"{_id}_newline_policy", RUNS, RUNS_SQL, lambda t, n=_lengths: T.newline_policy(t, n), policy_sql(_lengths))


@query("C11_newline_single_pass", f"SELECT doc_id, {policy_sql(T.NEWLINE_POLICIES['C6'], f'substring({RUNS_SQL}, 1, length({RUNS_SQL}) - 1)')} AS out FROM documents")
def newline_single_pass(spark, sf_dir):
    """Repair first, then the pass; the table's texts are sound, so SQL leaves repair out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(RUNS).alias("text"))
    return repair.mapped(docs, repair.fix).select("doc_id", T.newline_single_pass(F.col("text"), T.NEWLINE_POLICIES["C6"]).alias("out"))


HEAD = "concat('A: ', left(text, 250), ' <b>?*')"
projected("C15_file_name", HEAD, "'A: ' || left(text, 250) || ' <b>?*'", T.file_name, r"""coalesce(nullif(left(trim(regexp_replace(regexp_replace({t}, '[<>:"/\\|?*]', '', 'g'), '\s+', ' ', 'g')), 200), ''), 'untitled')""")
LINES = "array_join(transform(split(text, '\\n', -1), (x, i) -> if(i % 5 = 0, concat('#', x), x)), '\\n')"
LINES_SQL = "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN (i - 1) % 5 = 0 THEN '#' || x ELSE x END), chr(10))"
projected("C16_strip_comments", LINES, LINES_SQL, T.strip_comments, "array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT starts_with(x, '#')), chr(10))")
projected("C17_lower", "text", "text", F.lower, "lower({t})")
projected("C18_words_and_characters", "text", "text", lambda t: F.concat_ws("/", T.word_count(t), F.length(t)), r"concat_ws('/', len(regexp_extract_all({t}, '\S+')), length({t}))")
projected("C19_work_id", "concat('Work (x) ', doc_id, ' (', doc_id % 90, ').txt')", "'Work (x) ' || doc_id || ' (' || doc_id % 90 || ').txt'", T.work_id, "list_extract(string_split(string_split({t}, ').txt')[1], '('), -1)")
projected("C20_title", "concat(text, if(doc_id % 2 = 0, ' by me', ''), if(doc_id % 3 = 0, ' by us', ''))", "text || CASE WHEN doc_id % 2 = 0 THEN ' by me' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' by us' ELSE '' END", T.title, "CASE WHEN len(string_split({t}, ' by ')) > 2 THEN list_extract(string_split({t}, ' by '), -2) ELSE string_split({t}, ' by ')[1] END")
projected("C27_display", "left(text, 20 + cast(doc_id % 40 AS int))", "left(text, CAST(20 + doc_id % 40 AS INT))", T.display, r"(WITH s AS (SELECT replace(replace({t}, chr(10), '\n'), chr(9), '\t') AS x) SELECT CASE WHEN length(x) > 40 THEN left(x, 37) || '...' ELSE x END FROM s)")
projected("A7_document", "text", "text", T.document, "'<BOS>' || chr(10) || {t} || chr(10) || '<EOS><SEP>'")
ALPHABET = {c: i for i, c in enumerate(" etaoinshrdlu")}
projected("C24_encode_characters", "text", "text", lambda t: F.array_join(T.encode_characters(t, ALPHABET, 99).cast("array<string>"), " "), "array_to_string(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CASE WHEN contains(' etaoinshrdlu', c) THEN strpos(' etaoinshrdlu', c) - 1 ELSE 99 END), ' ')")
projected("C26_decode", "text", "text", lambda t: T.decode_ids(T.encode_characters(t, ALPHABET, 99), {i: c for c, i in ALPHABET.items()}), "array_to_string(list_transform(list_filter(string_split({t}, ''), lambda c: c <> ''), lambda c: CASE WHEN contains(' etaoinshrdlu', c) THEN c ELSE '?' END), '')")
VOCABULARY = ["<PAD>", "<UNK>", "<BOS>", "<EOS>", " ", "the", "and", "of", "de", "la", "und", "el"]
WORD_IDS = {w: i for i, w in enumerate(VOCABULARY)}
_SPACED_SQL = "flatten(list_transform(string_split({t}, ' '), lambda w, i: CASE WHEN i = 1 THEN [w] ELSE [' ', w] END))"
_WORD_TOKENS_SQL = f"list_concat(['<BOS>'], list_filter({_SPACED_SQL}, lambda w: w <> ''), ['<EOS>'])"
_WORD_IDS_SQL = f"list_transform(list_concat(['<BOS>'], {_SPACED_SQL}, ['<EOS>']), lambda w: coalesce(list_position([{', '.join(map(repr, VOCABULARY))}], w) - 1, 1))"
projected("C25_word_tokens", "text", "text", lambda t: F.array_join(T.word_tokens(t), "|"), f"array_to_string({_WORD_TOKENS_SQL}, '|')")
projected("C25_word_ids", "text", "text", lambda t: F.array_join(T.encode_words(T.word_tokens(t, empty=True), WORD_IDS, 512).cast("array<string>"), " "), f"(WITH a AS (SELECT {_WORD_IDS_SQL} AS x) SELECT array_to_string(list_concat(x, list_transform(range(greatest(512 - len(x), 0)), lambda i: 0)), ' ') FROM a)")
_footers, _headers, _updates = T.LICENSE_FOOTERS, T.LICENSE_HEADERS, T.LICENSE_UPDATES


def _quoted(m: str, sql: bool) -> str:
    return m.replace("\n", "' || chr(10) || '" if sql else "\\n")


def _licensed(sql: bool) -> str:
    case = (lambda c, m: f"CASE WHEN {c} THEN '{_quoted(m, True)}' ELSE '' END") if sql else (lambda c, m: f"if({c}, '{_quoted(m, False)}', '')")
    parts = ["'top '", case("doc_id % 4 = 1", _headers[1][0]), case("doc_id % 4 = 2", _headers[6][0]), RUNS_SQL if sql else RUNS]
    parts += [case("doc_id % 3 = 1", _footers[1][0]), "' more '", case("doc_id % 5 = 1", _updates[0][0]), "' end'"]
    return " || ".join(parts) if sql else f"concat({', '.join(parts)})"


def _trim_sql() -> str:
    """As common table expressions: one step for each family of markers."""
    lit = lambda m: "'" + _quoted(m, True) + "'"
    ctes = [f"d AS (SELECT doc_id, {_licensed(True)} AS t FROM documents)", "s0 AS (SELECT doc_id, string_split(" + TABS_SQL.replace("{t}", SPACES_SQL.replace("{t}", "t")) + ", '***** This file should be named')[1] AS t, false AS hit FROM d)"]
    for n, (markers, part) in enumerate(((_footers, 1), (_headers, 2), (_updates, 1))):
        whens = []
        for m, times in markers:
            x = f"string_split(t, ({lit(m)}))[{part}]"
            for _ in range(times):
                x = cascade_sql(3, 3, x)
            whens.append(f"WHEN contains(t, ({lit(m)})) THEN {x}")
        any_ = " OR ".join(f"contains(t, ({lit(m)}))" for m, _ in markers)
        ctes.append(f"s{n + 1} AS (SELECT doc_id, CASE {' '.join(whens)} ELSE t END AS t, hit OR {any_} AS hit FROM s{n})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, CASE WHEN hit THEN t ELSE {cascade_sql(3, 3, cascade_sql(3, 3, 't'))} END AS out FROM s3"


@query("C14_trim_license", _trim_sql())
def trim_license(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.expr(_licensed(False)).alias("text"))
    return docs.select("doc_id", T.trim_license(F.col("text")).alias("out"))


_WORDS_SQL = "len(regexp_extract_all({t}, '\\S+'))"


@query("G3_before_after", f"SELECT lang, CAST(sum(before) AS BIGINT) AS before, CAST(sum(length(out)) AS BIGINT) AS after, CAST(sum(words_before) AS BIGINT) AS words_before, CAST(sum({_WORDS_SQL.replace('{t}', 'out')}) AS BIGINT) AS words_after FROM (SELECT doc_id, lang, length(t) AS before, {_WORDS_SQL.replace('{t}', 't')} AS words_before FROM (SELECT doc_id, lang, {_licensed(True)} AS t FROM documents)) d JOIN ({_trim_sql()}) x USING (doc_id) GROUP BY ROLLUP (lang)")
def before_after(spark, sf_dir):
    """Characters and words before and after the license trim, with the total."""
    docs = table(spark, sf_dir, "documents").select("lang", F.expr(_licensed(False)).alias("text"))
    docs = docs.withColumn("out", T.trim_license(F.col("text")))
    return docs.rollup("lang").agg(F.sum(F.length("text")).alias("before"), F.sum(F.length("out")).alias("after"), F.sum(T.word_count(F.col("text"))).alias("words_before"), F.sum(T.word_count(F.col("out"))).alias("words_after"))


@query("C21_title_tag", "SELECT page_id, CASE WHEN contains(html, '<title>') THEN string_split(string_split(html, '<title>')[2], '</title>')[1] END AS out FROM pages")
def title_tag(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.between(F.col("html"), "<title>", "</title>").alias("out"))


#: A listing page made of a table's page: a section with a header and an ordered list of works.
_LISTING = (("<nav>", '<div class="main page_content"><h2 id="books-last30">Top</h2><p>Works</p>'), ("</nav>", "</div>"), ("<ul>", "<ol>"), ("</ul>", "</ol>"), ('<a href="/', '<a href="/ebooks/'), ("</a></li>", " by Someone</a></li>"))


def _unescaped(x: str) -> str:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    return x


_HREF, _TITLE = (f"unnest(list_transform(m, lambda x: regexp_extract(x, '{p}', 1)))" for p in ('<a href="/([^"]*)"', ">([^<]*)</a>"))
_LINKS_SQL = f"""SELECT page_id, unnest(range(1, len(m) + 1)) AS item, {_unescaped(_HREF)} AS work, {_unescaped(_TITLE)} AS title
    FROM (SELECT page_id, regexp_extract_all(string_split(string_split(html, '<ul>')[2], '</ul>')[1], '<a href="[^"]*">[^<]*</a>') AS m FROM pages)"""


def _listings(spark, sf_dir):
    page = F.col("html")
    for old, new in _LISTING:
        page = F.replace(page, F.lit(old), F.lit(new))
    return pages.listed_links(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_content", "books-last30")


@query("C22_list_links", f"SELECT page_id, item, '/ebooks/' || work AS href, trim(title || ' by Someone') AS title FROM ({_LINKS_SQL})")
def list_links(spark, sf_dir):
    return _listings(spark, sf_dir)


@query("C22_catalog", f"SELECT page_id, work AS work_id, arg_max(trim(title), item) AS name FROM ({_LINKS_SQL}) GROUP BY page_id, work")
def listed_works(spark, sf_dir):
    return pages.catalog(_listings(spark, sf_dir), "ebooks/")


@query(
    "C22_elements",
    r"""SELECT page_id, lower(tag) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(<(?:script|style)[^>]*>).*?(</(?:script|style))', '\1\2', 'gs'), '<([a-zA-Z][^\s/>]*)[^>]*>', 1)) AS tag FROM pages) GROUP BY ALL""",
)
def page_elements(spark, sf_dir):
    """Elements of each tag on every page; what scripts, styles and comments hold is none."""
    return pages.elements(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


_SITE = ("regexp_extract(url, '://([^/?#]*)', 1) AS host", "regexp_extract(url, '://[^/?#]*(/[^?#]*)', 1) AS path")
#: Rules of each host, from its own pages: all may be read, some languages not, some numbers of those after all.
_ROBOTS = """SELECT host, '/' AS prefix, 1 AS allow FROM {s} UNION SELECT host, concat('/', split_part(path, '/', 2), '/') AS prefix, 0 AS allow FROM {s} WHERE page_id % 3 = 0
    UNION SELECT host, concat('/', split_part(path, '/', 2), '/', left(split_part(path, '/', 3), 1)) AS prefix, page_id % 2 AS allow FROM {s} WHERE page_id % 5 = 0"""


@query(
    "A14_robots",
    f"WITH s AS (SELECT page_id, {', '.join(_SITE)} FROM pages), r AS ({_ROBOTS.format(s='s')}) SELECT s.page_id, s.host, coalesce(arg_max(r.allow, length(r.prefix) * 2 + r.allow), 1) AS allowed FROM s LEFT JOIN r ON r.host = s.host AND starts_with(s.path, r.prefix) GROUP BY s.page_id, s.host",
)
def robots(spark, sf_dir):
    """May a page be read? The longest rule of its host says so; of equal ones that which allows."""
    site = table(spark, sf_dir, "pages").selectExpr("page_id", *_SITE)
    rules = spark.sql(_ROBOTS, s=site)
    out = prefixes.longest(site, rules, "host", "path", "prefix", F.col("allow"), "allow")
    return out.select("page_id", "host", F.coalesce("allow", F.lit(1)).alias("allowed"))


@query(
    "C29_model_suffix",
    r"SELECT event_id, regexp_extract(f, '_step_([0-9]+)', 1) AS step, contains(f, 'CleanSlate') AS fresh, contains(f, '_best_test') AS best FROM (SELECT event_id, 'net' || CASE event_id % 3 WHEN 0 THEN '_step_' || event_id WHEN 1 THEN 'CleanSlate' ELSE '_best_test' END || '.pth' AS f FROM events)",
)
def model_suffix(spark, sf_dir):
    f = F.expr("concat('net', case event_id % 3 when 0 then concat('_step_', event_id) when 1 then 'CleanSlate' else '_best_test' end, '.pth')")
    ev = table(spark, sf_dir, "events").select("event_id", f.alias("f"))
    return ev.select("event_id", F.regexp_extract("f", "_step_([0-9]+)", 1).alias("step"), F.contains("f", F.lit("CleanSlate")).alias("fresh"), F.contains("f", F.lit("_best_test")).alias("best"))


projected("C28_tidy_question", "replace(text, 'the', ' . ')", "replace(text, 'the', ' . ')", T.tidy_question, "(WITH a AS (SELECT trim(replace({t}, '  ', ' '), ' ' || chr(10) || chr(9) || chr(13)) AS x), b AS (SELECT CASE WHEN right(x, 1) IN ('.', '?', '!') THEN x WHEN contains(x, '?') THEN x || '?' ELSE x || '.' END AS x FROM a) SELECT CASE WHEN right(x, 2) IN ('..', '??') THEN left(x, length(x) - 1) ELSE x END FROM b)")
