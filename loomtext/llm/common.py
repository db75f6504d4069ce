"""What the training-data operators share: shared-folder tables, Arrow text
batches, a join that survives hot keys and connected components.

Texts are addressed by content wherever a result has to be joined back: rows
that repeat a doc_id, or have none, then need no special handling.
"""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that may be broadcast as "hot": the limit bounds the broadcast by
#: itself, and every key that isn't among them takes the shuffled path. Such a key
#: holds less than a thousandth of the rows; adaptive execution splits it further.
HOT_KEYS = 1000
#: Bytes of text that one step of a vectorised loop holds.
CHUNK_BYTES = 1 << 21
#: The same where a step makes several numbers of 8 bytes for each byte: its arrays are what
#: a worker, which Spark uses again, goes on holding.
STEP_BYTES = 1 << 18

#: ASCII upper case to lower case, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of
    the session, or the checkpoint folder that was set on its context. A local
    master without one gets a folder beside its warehouse."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path and sc.master.startswith("local"):
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/.loomtext"
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, deleted when its driver ends."""
    path = f"{shared_dir(spark)}/loomtext/{spark.sparkContext.applicationId}"
    if path not in _RUNS:
        _RUNS.add(path)
        atexit.register(_remove, spark, path)
    return path


_RUNS: set[str] = set()


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is None or spark.sparkContext._jsc is None:
        return  # the session is over; its folder is left to the cluster's cleaning
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the
    lineage, survives lost executors, and gives the planner real sizes."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if "/loomtext/" in folder:
                path.getFileSystem(conf).delete(path, True)


def unused(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has, whatever the case."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        out.append(name)
    return out


def digest(text: Column) -> Column:
    """SHA-256 of the text as 32 bytes; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def crc_mod(doc_id: str, m: int) -> Column:
    """crc32 of doc_id as text, modulo m; 0 for a null doc_id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % m, F.lit(0))


def spread_join(left: DataFrame, right: DataFrame, on: str, weight: str, salt: Column) -> DataFrame:
    """Left join with a ``right`` that has one row a key, where few keys may hold
    most of ``left``. The HOT_KEYS keys of greatest ``weight`` (the number of
    rows of ``left`` they stand for) come by a broadcast of at most HOT_KEYS
    rows; their rows then leave the shuffle key for a spread one, and all other
    keys join by shuffle. Every row of ``left`` comes out once."""
    cols = [c for c in right.columns if c != on]
    hot = right.filter(F.col(weight) > 1).orderBy(F.col(weight).desc(), F.col(on)).limit(HOT_KEYS)
    hot = hot.select(F.col(on).alias("__k"), F.struct(*cols).alias("__hot"))
    left = left.join(F.broadcast(hot), F.col(on) == F.col("__k"), "left").drop("__k")
    kind = dict(right.dtypes)[on]
    key = F.col(on).cast("binary") if kind == "binary" else F.unhex(F.hex(F.col(on)))
    tail = F.when(F.col("__hot").isNull(), F.unhex(F.lit(""))).otherwise(F.unhex(F.lpad(F.hex(salt), 16, "0")))
    left = left.withColumn("__j", F.concat(key, F.unhex(F.when(F.col("__hot").isNull(), "00").otherwise("01")), tail))
    rkey = F.col(on).cast("binary") if kind == "binary" else F.unhex(F.hex(F.col(on)))
    rest = right.select(F.concat(rkey, F.unhex(F.lit("00"))).alias("__j"), F.struct(*cols).alias("__rest"))
    out = left.join(rest, "__j", "left")
    got = F.coalesce(F.col("__hot"), F.col("__rest"))
    return out.select(*[c for c in left.columns if not c.startswith("__")], *[got[c].alias(c) for c in cols])


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Cut a string array into runs of rows of about ``size`` bytes. Yields
    (first row, offsets, bytes): int64 offsets from 0 and the UTF-8 bytes of the
    run. Null counts as empty. A longer text is a run of its own."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, off_buf, data_buf = column.buffers()
    off = np.frombuffer(off_buf, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, off[row : end + 1] - off[row], data[off[row] : off[end]]
        row = end


def bitmap(numbers: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """A bitmap of fixed size (8 MB) with the bit of each number of a one-column table,
    modulo ``bits``: to pick rows before they move. Fuller, it picks more than needed."""
    place = F.pmod(F.col(numbers.columns[0]), F.lit(bits)) + 1
    rows = numbers.groupBy(F.bitmap_bucket_number(place).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def picked(marks: np.ndarray, number: int) -> bool:
    """Is the number's bit set?"""
    at = number % (len(marks) * 8)
    return bool(marks[at >> 3] >> (at & 7) & 1)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) by alternating large
    and small stars: (node, root), root the smallest node of the component.

    Every round writes its edges to the shared folder; the work of a round is
    linear in the edges, and hub nodes are handled by :func:`spread_join`.
    """
    spark = edges.sparkSession
    edges = materialise(_oriented(edges), "edges")
    before = None
    while True:  # settles: a round that changes nothing is the last
        after = materialise(_small_star(_large_star(edges)), "edges")
        discard(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _oriented(edges: DataFrame) -> DataFrame:
    """(a, b) with a > b, each once."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with ``m``: the smallest of a and its b."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return spread_join(pairs, least, "a", "n", F.col("b"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a"))
    got = _with_least(both).withColumn("m", F.least("a", "m")).filter("b > a")
    return got.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    got = _with_least(edges)
    pairs = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))
    return got.select(F.explode(pairs).alias("p")).select("p.a", "p.b").filter("a <> b").distinct()
