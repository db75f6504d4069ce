"""Queries of sections 2.A, 2.B and 2.L that go through files: a tree of documents by source
is written to the shared folder and read back, caches and indexes likewise."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomtext.functions import text as T
from loomtext.operators import dedup, recurrences
from loomtext.plans.registry import query
from loomtext.plans.relational import DIALECT, MARK
from loomtext.sources import corpus, index, stores, tree_writer
from loomtext.sources.shared import scratch
from loomtext.sources.tables import table


#: Documents as files of a tree: most by source, every twentieth in a folder of events, every fiftieth
#: at the root; some that aren't texts by name, and some whose bytes aren't UTF-8.
_CATEGORY = "CASE WHEN doc_id % 50 = 0 THEN NULL WHEN doc_id % 20 = 7 THEN {0} ELSE source END"
_PLANTED: dict[tuple[str, str], str] = {}


def _plant(spark, sf_dir):
    """The tree of a table, written once in an application by the tree writer."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PLANTED:
        root = scratch(spark, "tree")
        name = F.concat(F.lit("Work by "), "lang", F.lit(" ("), "doc_id", F.lit(")"), F.when(F.col("doc_id") % 9 == 0, ".IGNORE").otherwise(".txt"))
        content = F.when(F.col("doc_id") % 7 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF0D0A")))).otherwise(F.encode("text", "UTF-8"))
        docs = table(spark, sf_dir, "documents").filter("text <> ''")
        tree_writer.save(docs.select(F.expr(_CATEGORY.format("concat(source, '/events')")).alias("category"), name.alias("file_name"), content.alias("content")), root)
        _PLANTED[key] = root
    return _PLANTED[key]


_FILES = f"""SELECT doc_id, text, category, file_name, coalesce(category || '/', '') || file_name AS relative FROM (
    SELECT doc_id, text, {_CATEGORY.format("source || '/events'")} AS category, 'Work by ' || lang || ' (' || doc_id || ')' || CASE WHEN doc_id % 9 = 0 THEN '.IGNORE' ELSE '.txt' END AS file_name FROM documents WHERE text <> '')"""
_FIRST = "(SELECT min(source) FROM documents)"


@query("A1_files", f"SELECT file_name, strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS length FROM ({_FILES}) WHERE category = {_FIRST}")
def files(spark, sf_dir):
    first = table(spark, sf_dir, "documents").agg(F.min("source")).first()[0]
    return corpus.files(spark, f"{_plant(spark, sf_dir)}/{first}").select("file_name", "length")


@query("A2_folders", f"SELECT DISTINCT split_part(category, '/', 1) AS folder FROM ({_FILES}) WHERE category IS NOT NULL")
def folders(spark, sf_dir):
    return corpus.folders(spark, _plant(spark, sf_dir))


@query("A3_recursive", f"SELECT relative, row_number() OVER (ORDER BY CASE WHEN category IS NULL THEN '0' || file_name WHEN contains(category, '/') THEN '1' || split_part(category, '/', 1) || chr(1) || '1' || split_part(category, '/', 2) || chr(1) || '0' || file_name ELSE '1' || category || chr(1) || '0' || file_name END) AS ord FROM ({_FILES})")
def recursive(spark, sf_dir):
    root = _plant(spark, sf_dir)
    return corpus.ordered(corpus.files(spark, root, recursive=True), root)


@query("A4_scan", f"SELECT category, file_name, text FROM ({_FILES}) WHERE category NOT LIKE '%/%' AND file_name LIKE '%.txt' AND doc_id % 7 <> 0")
def scan(spark, sf_dir):
    """The tree's texts, without those whose bytes aren't UTF-8."""
    return corpus.scan(spark, _plant(spark, sf_dir)).filter(F.is_valid_utf8("text"))


@query("A5_sample", f"SELECT relative, sha256(text) AS digest FROM ({_FILES}) WHERE doc_id % 9 <> 0 AND doc_id % 7 <> 0 ORDER BY CAST('0x' || left(md5('52:' || relative), 15) AS BIGINT) LIMIT 60")
def sample(spark, sf_dir):
    return corpus.sample(spark, _plant(spark, sf_dir), 60).select("relative", F.sha2("text", 256).alias("digest"))


@query("A6_first", f"SELECT file_name FROM ({_FILES}) WHERE category NOT LIKE '%/%' AND file_name LIKE '%.txt' ORDER BY file_name LIMIT 10")
def first(spark, sf_dir):
    """Names alone give the order; no text is opened for it."""
    return corpus.first(corpus.entries(spark, _plant(spark, sf_dir)), 10).select("file_name")


_HIGH = bytes(range(128, 256)).decode("cp437")
_BYTES = "hex(encode(text)) || CASE WHEN doc_id % 7 = 0 THEN 'FF0D0A' ELSE '' END"


@query(
    "A9_decode",
    f"""WITH h AS (SELECT doc_id, regexp_extract_all({_BYTES}, '..') AS h FROM ({_FILES}) WHERE category NOT LIKE '%/%' AND file_name LIKE '%.txt'),
    b AS (SELECT doc_id, unnest(range(len(h))) AS i, unnest(h) AS x FROM h),
    c AS (SELECT format('{{:02X}}', n) AS x, CASE WHEN n < 128 THEN chr(n) ELSE '{_HIGH}'[n - 127] END AS c FROM (SELECT CAST(unnest(range(256)) AS INT) AS n))
    SELECT sha256(replace(replace(string_agg(c.c, '' ORDER BY b.i), chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS digest FROM b JOIN c USING (x) GROUP BY doc_id""",
)
def decode(spark, sf_dir):
    root = _plant(spark, sf_dir)
    raw = corpus.opened(corpus.entries(spark, root), root)
    return corpus.decode_bytes(raw).select(F.sha2("text", 256).alias("digest"))


@query("A10_event_scripts", f"SELECT split_part(category, '/', 1) AS container, file_name, lower(text) AS content FROM ({_FILES}) WHERE category LIKE '%/events' AND doc_id % 7 <> 0")
def event_scripts(spark, sf_dir):
    return corpus.scripts(spark, _plant(spark, sf_dir), "events")


@query("A12_dataset_buckets", f"SELECT {MARK} AS marker, doc_id AS idx, text, n FROM (SELECT doc_id, text, {DIALECT['SPLIT_WORDS'][1]} AS n FROM documents)")
def dataset_buckets(spark, sf_dir):
    """A dataset stored by the bucket of its texts' lengths in words, and loaded again."""
    folder = scratch(spark, "dataset")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text", T.word_count(F.col("text")).cast("long").alias("n"))
    stores.save_dataset(docs.withColumn("marker", F.expr(DIALECT["MARK"][0])), folder)
    return stores.load_dataset(spark, folder)


@query("A20_token_cache", "SELECT doc_id, len(ids) AS length, CAST(list_sum(ids) AS BIGINT) AS total FROM (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w) + 1) AS ids FROM documents)")
def token_cache(spark, sf_dir):
    folder = scratch(spark, "tokens")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w) + 1).alias("ids"))
    stores.save_tokens(docs, folder)
    back = stores.load_tokens(spark, folder)
    return back.select("doc_id", F.col("length").cast("long").alias("length"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("B1_save", "SELECT source AS category, 'w' || doc_id || '.txt' AS file_name, text FROM documents WHERE text <> ''")
def save(spark, sf_dir):
    """What A4 reads of what the tree writer wrote; its reader leaves empty files out."""
    folder = scratch(spark, "catalog")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("category"), F.concat(F.lit("w"), "doc_id", F.lit(".txt")).alias("file_name"), "text")
    tree_writer.save(rows, folder)
    return corpus.scan(spark, folder)


@query("B6_metrics", "SELECT kind, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type AS kind, value FROM events UNION ALL SELECT 'avg' AS kind, value FROM events) GROUP BY kind")
def metrics(spark, sf_dir):
    folder, ev = scratch(spark, "metrics"), table(spark, sf_dir, "events")
    rows = ev.select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value", F.col("event_type").alias("kind"))
    stores.append_metrics(rows, folder)
    stores.append_metrics(rows.withColumn("kind", F.lit("avg")), folder)
    return stores.load_metrics(spark, folder).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("B7_model", "SELECT n_nationkey AS token_id, n_name AS token, 'names' AS model, '64' AS hidden FROM nation")
def model(spark, sf_dir):
    folder = scratch(spark, "model")
    vocabulary = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("token_id"), F.col("n_name").alias("token"))
    stores.save_model(vocabulary, {"model": "names", "hidden": "64"}, folder)
    back, config = stores.load_model(spark, folder, "token_id int, token string", "model string, hidden string")
    return back.crossJoin(F.broadcast(config))


@query("B8_frequencies", "WITH f AS (SELECT p_type AS token, count(*) AS n FROM part GROUP BY p_type) SELECT token, n, (SELECT count(*) FROM f) AS vocab_size, CAST((SELECT sum(n) FROM f) AS BIGINT) AS total FROM f")
def frequencies(spark, sf_dir):
    folder = scratch(spark, "frequencies")
    stores.save_frequencies(table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("token")).agg(F.count("*").alias("n")), folder)
    return spark.read.schema("token string, n long, vocab_size long, total long").parquet(folder)


@query("G24_parameters", "SELECT CAST(sum(len(embedding)) AS BIGINT) AS parameters FROM embeddings")
def parameters(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").agg(F.sum(F.size("embedding")).alias("parameters"))


@query("J4_split_documents", "SELECT doc_id, pos, piece FROM (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS piece FROM (SELECT doc_id, string_split('<BOS>' || chr(10) || text || chr(10) || '<EOS><SEP>', '<SEP>') AS p FROM documents)) WHERE piece <> ''")
def split_documents(spark, sf_dir):
    """The corpus as one text split at its separators; each document's share stays a row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.document(F.col("text")), "<SEP>", -1)).alias("pos", "piece"))
    return docs.filter("piece <> ''").select("doc_id", F.col("pos").cast("long").alias("pos"), "piece")


@query("K3_dedup_stats", "SELECT 'precise' AS mode, seen, kept, seen - kept AS removed FROM (SELECT count(*) AS seen, count(DISTINCT w) AS kept FROM (SELECT hash(substring(text, CAST(p + 1 AS INT), 100)) AS w FROM (SELECT text, unnest(range(greatest(length(text) - 99, 1))) AS p FROM documents))) UNION ALL SELECT 'efficient' AS mode, count(*) AS seen, NULL AS kept, NULL AS removed FROM documents")
def dedup_stats(spark, sf_dir):
    """What each mode reads, and what the first keeps of it; K2 holds what the other keeps."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    told = lambda c: F.when(F.col("mode") == "precise", F.col(c)).alias(c)
    both = [dedup.statistics(docs, mode).withColumn("mode", F.lit(mode)).select("mode", "seen", told("kept"), told("removed")) for mode in ("precise", "efficient")]
    return both[0].union(both[1])


@query("K3_deduplicate")
def deduplicate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text")
    both = [dedup.statistics(docs, mode).withColumn("mode", F.lit(mode)) for mode in ("precise", "efficient")]
    return both[0].union(both[1])


@query("L_rate_code", "SELECT vec_id, label, CAST(sum(spikes) AS BIGINT) AS spikes FROM (SELECT vec_id, label, len(list_filter(range(1, 9), lambda t: 1 / (1 + exp(-CAST(v AS DOUBLE))) > t / 8.0)) AS spikes FROM (SELECT vec_id, label, unnest(embedding) AS v FROM embeddings)) GROUP BY vec_id, label")
def rate_code(spark, sf_dir):
    trains = F.transform(F.col("embedding").cast("array<double>"), lambda v: recurrences.rate_code(v, 8))
    count = F.aggregate(F.flatten(trains), F.lit(0).cast("long"), lambda a, s: a + s.cast("long"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", count.alias("spikes"))


@query("L_rms_norm", "SELECT vec_id, pos, round(v / sqrt(m + 1e-6), 6) AS y FROM (SELECT vec_id, unnest(range(len(embedding))) AS pos, CAST(unnest(embedding) AS DOUBLE) AS v, list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS m FROM embeddings)")
def rms_norm(spark, sf_dir):
    normed = recurrences.rms_norm(F.col("embedding").cast("array<double>"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(normed).alias("pos", "y"))
    return rows.select("vec_id", F.col("pos").cast("long").alias("pos"), F.round("y", 6).alias("y"))


#: Index paragraphs of documents: a title line with the id at its end (every seventh too near the
#: title to count), an author, a language note for some; between them, paragraphs without an id
#: and such as carry on another.
_RECORD = (
    "concat(left(split(text, '\\n')[0], 60), repeat(' ', if(doc_id % 7 = 0, 2, 12)), doc_id, '\\n by Someone', if(lang = 'en', '', concat('\\n [Language: ', lang, ']')), if(doc_id % 11 = 0, '\\n In English', ''))",
    "left(string_split(text, chr(10))[1], 60) || repeat(' ', CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 12 END) || doc_id || chr(10) || ' by Someone' || CASE WHEN lang = 'en' THEN '' ELSE chr(10) || ' [Language: ' || lang || ']' END || CASE WHEN doc_id % 11 = 0 THEN chr(10) || ' In English' ELSE '' END",
)


@query(
    "C23_index_lookup",
    f"""WITH r AS (SELECT doc_id AS id, {_RECORD[1]} AS t FROM documents), e AS (SELECT id, string_split(t, chr(10))[1] AS line, contains(t, '[Language: ') AND NOT contains(t, 'English') AS foreign_ FROM r WHERE t[1] <> ' '),
    f AS (SELECT id, split_part(line, '   ', 1) || ' (' || id || ')' || CASE WHEN foreign_ THEN '.IGNORE' ELSE '.txt' END AS name FROM e WHERE line LIKE '%   ' || id AND replace(right(line, 10), ' ', '') = CAST(id AS VARCHAR))
    SELECT w.work_id, f.name FROM (SELECT DISTINCT doc_id AS work_id FROM labels UNION SELECT doc_id + 1000000000 AS work_id FROM labels WHERE toxic = 1) w LEFT JOIN f ON f.id = w.work_id""",
)
def index_lookup(spark, sf_dir):
    """Labelled documents, and some ids that no index has, in an index of all documents."""
    path = scratch(spark, "index")
    carried = F.concat(F.lit(" see also   "), F.col("doc_id") + 1)
    three = F.array(F.expr(_RECORD[0]), F.lit("A heading without a number"), carried)
    index.save(table(spark, sf_dir, "documents").select(F.explode(three).alias("record")), path)
    labels = table(spark, sf_dir, "labels")
    wanted = labels.select(F.col("doc_id").alias("work_id")).union(labels.filter("toxic = 1").select(F.col("doc_id") + 1000000000))
    return index.lookup(spark, path, wanted)
