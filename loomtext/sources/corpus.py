"""Corpus trees: listing, scanning, sampling, decoding and renaming.

Tasks list a tree's folders, level by level, and open its files: a tree has far more files
than a driver's index or a task each could take, and no path of a file goes through the
driver. One folder's own names are listed by one task. A tree may lie in any store that
Arrow's file systems know, as the tree writer's. Hidden and empty files are left out.
"""

from __future__ import annotations

import fnmatch
import functools
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import numbering, selection
from loomtext.sources.shared import checkpointed, small

#: Files and bytes that a task opens, about, and bytes of a batch.
_FILES, _BYTES, _BATCH = 5000, 1 << 26, 1 << 22


def _store(root: str) -> tuple[fs.FileSystem, str]:
    store, at = fs.FileSystem.from_uri(root)
    return store, at.rstrip("/")


def _regex(pattern: str) -> str:
    """A pattern of names as a regular expression: *, ?, [..] and {a,b}."""
    if inner := re.search(r"\{([^{}]*)\}", pattern):
        return "|".join(_regex(pattern[: inner.start()] + x + pattern[inner.end() :]) for x in inner[1].split(","))
    return fnmatch.translate(pattern.replace("[^", "[!"))


def _matches(names: Column, pattern: str) -> Column:
    found = re.compile(_regex(pattern))
    like = F.udf(lambda x: found.match(x) is not None, "boolean")
    plain = re.fullmatch(r"\*([^][*?{}\\]*)", pattern)
    return names.endswith(plain[1]) if plain else like(names)


def _level(folders: DataFrame, root: str) -> DataFrame:
    """(relative, name, length, is_folder) of what folders (relative) have right below them."""

    def run(batches):
        store, at = _store(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                found = store.get_file_info(fs.FileSelector(f"{at}/{folder}" if folder else at))
                for some in (found[i : i + 10_000] for i in range(0, len(found), 10_000)):
                    names = [x.base_name for x in some]
                    cols = [[f"{folder}/{n}" if folder else n for n in names], names, [x.size or 0 for x in some], [x.type == fs.FileType.Directory for x in some]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.bool_()))], names=["relative", "name", "length", "is_folder"])

    spread = folders.select("relative").repartition(folders.sparkSession.sparkContext.defaultParallelism)
    return checkpointed(spread.mapInArrow(run, "relative string, name string, length long, is_folder boolean"))


def _top(spark: SparkSession, root: str) -> DataFrame:
    store, at = _store(root)
    if store.get_file_info(at or "/").type != fs.FileType.Directory:
        raise FileNotFoundError(f"no folder: {root}")
    return _level(spark.createDataFrame([("",)], "relative string"), root)


def _shown() -> Column:
    """Names that readers don't hide."""
    name = F.col("name")
    return ~(name.startswith(".") | (name.startswith("_") & ~name.contains("=")) | name.endswith("._COPYING_"))


def _files(level: DataFrame, pattern: str) -> DataFrame:
    return level.filter(~F.col("is_folder") & (F.col("length") > 0) & _shown() & _matches(F.col("name"), pattern))


def files(spark: SparkSession, folder: str, recursive: bool = False, pattern: str | None = None) -> DataFrame:
    """(path, file_name, folder, length) of a folder's files (A1-A3), hidden and empty ones
    left out; a folder that isn't there is an error."""
    level = _top(spark, folder)
    levels = [level]
    while recursive and not (below := level.filter(F.col("is_folder") & _shown())).isEmpty():
        level = _level(below, folder)
        levels.append(level)
    found = _files(functools.reduce(DataFrame.union, levels), pattern or "*")
    path = F.concat(F.lit(folder.rstrip("/") + "/"), "relative")
    return found.select(path.alias("path"), F.col("name").alias("file_name"), F.element_at(F.split(path, "/"), -2).alias("folder"), "length")


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder) that a folder has right below it (A2), hidden ones left out."""
    return _top(spark, root).filter(F.col("is_folder") & _shown()).select(F.col("name").alias("folder")).orderBy("folder")


def _below(root: str) -> Column:
    """The part of ``path`` below a root."""
    return F.substring("path", len(root.rstrip("/")) + 2, 1 << 30)


def opened(found: DataFrame, root: str) -> DataFrame:
    """(relative, content binary) of files (relative, length), dealt to tasks in shares of
    about equal number."""

    def run(batches):
        store, at = _store(root)
        for b in batches:
            names, out, size = [], [], 0
            for name in b.column(0).to_pylist():
                with store.open_input_stream(f"{at}/{name}") as f:
                    content = f.read()
                names.append(name)
                out.append(content)
                size += len(content)
                if size >= _BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["relative", "content"])
                    names, out, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.binary())], names=["relative", "content"])

    n, size = found.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(found.sparkSession.sparkContext.defaultParallelism, n // _FILES, size // _BYTES)
    return found.select("relative").repartition(parts).mapInArrow(run, "relative string, content binary")


def entries(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(relative, category, file_name, length) of <root>/<category>/<file>."""
    found = _files(_level(_top(spark, root).filter("is_folder"), root), pattern)
    return found.select("relative", F.substring_index("relative", "/", 1).alias("category"), F.col("name").alias("file_name"), "length")


def ordered(tree: DataFrame, root: str) -> DataFrame:
    """(relative, ord) of files: a folder's own before those of its folders (A3)."""
    relative = _below(root)
    parts = F.split("relative", "/")
    key = F.transform(parts, lambda x, i: F.concat(F.when(i == F.size(parts) - 1, F.lit("0")).otherwise(F.lit("1")), x))
    return numbering.numbered(tree.select(relative.alias("relative")).withColumn("key", key), ["key"], "ord").drop("key")


def scan(spark: SparkSession, root: str, pattern: str = "*.txt") -> DataFrame:
    """(category, file_name, text) of <root>/<category>/<file> (A4)."""
    parts = F.split("relative", "/")
    df = opened(entries(spark, root, pattern), root)
    return df.select(parts[0].alias("category"), parts[1].alias("file_name"), F.col("content").cast("string").alias("text"))


def scripts(spark: SparkSession, root: str, folder: str, pattern: str = "*") -> DataFrame:
    """(container, file_name, content) of <root>/<container>/<folder>/<file>, in lower case;
    files that aren't UTF-8 are left out (A10)."""
    inner = _level(_top(spark, root).filter("is_folder"), root).filter(F.col("is_folder") & (F.col("name") == folder))
    text, parts = F.col("content").cast("string"), F.split("relative", "/")
    df = opened(_files(_level(inner, root), pattern), root).filter(F.is_valid_utf8(text))
    return df.select(parts[0].alias("container"), parts[2].alias("file_name"), F.lower(text).alias("content"))


def sample(spark: SparkSession, root: str, n: int, seed: int = 52, pattern: str = "*.txt") -> DataFrame:
    """(relative, text) of the first ``n`` readable files in a seeded shuffle of a tree's paths
    (A5). Files that aren't UTF-8 use no quota: the next ones are opened, in growing
    shares, until it's full or the tree is at its end."""
    names = files(spark, root, recursive=True, pattern=pattern).select(_below(root).alias("relative"), "length")
    names = checkpointed(names.withColumn("h", selection.seeded(F.col("relative"), seed)))
    found, ask, after = names.select("relative", F.lit("").alias("text")).limit(0), n, -1
    while n > 0:
        rest = names.filter(F.col("h") > after)
        rank = selection.kth(rest.select("h"), ask)
        share = rest if rank is None else rest.filter(F.col("h") <= rank.value)
        text = F.col("content").cast("string")
        got = checkpointed(opened(share, root).filter(F.is_valid_utf8(text)).select("relative", text.alias("text")))
        h = selection.seeded(F.col("relative"), seed)
        full = selection.kth(got.select(h), n)
        found = found.union(got if full is None else got.filter(h <= full.value))
        if full is not None or rank is None:
            break
        n, after, ask = n - got.count(), rank.value, 2 * ask
    return found


def first(corpus: DataFrame, n: int, key: str = "file_name") -> DataFrame:
    """The first ``n`` rows by the key."""
    return corpus.orderBy(key).limit(n)


def decode_bytes(df: DataFrame, column: str = "content") -> DataFrame:
    """(text) of binary content: ASCII, else code page 437, which reads any byte, so
    that no further encoding is ever tried; line ends become newlines (A9)."""

    def run(batches):
        for b in small(batches):
            out = []
            for raw in b.column(0).to_pylist():
                try:
                    text = (raw or b"").decode("ascii")
                except UnicodeDecodeError:
                    text = raw.decode("cp437")
                out.append(text.replace("\r\n", "\n").replace("\r", "\n"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["text"])

    return df.select(column).mapInArrow(run, "text string")


def renamed(name: Column) -> Column:
    """prefix_ID.ext as "prefix (ID).ext" (B2)."""
    return F.regexp_replace(name, r"^(.*)_([^_.]*)\..*?([^.]*)$", "$1 ($2).$3")


def mirrored(path: Column, origin: str, target: str, extension: str | None = None) -> Column:
    """The path under another root, with another extension if one is named."""
    out = F.concat(F.lit(target), F.substring(path, F.lit(len(origin) + 1), F.length(path)))
    return out if extension is None else F.concat(F.regexp_replace(out, r"\.[^./]*$", ""), F.lit(extension))
