"""Trees of files: the writer's commit and abort, and samples with a quota."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loomtext.sources import corpus, tree_writer

ROWS = [("Art", "a%41 b (1).txt", "é\n"), ("Art/Old", "[x] {y}.txt", "old"), (None, "root.txt", "at the root"), ("Law", "empty.txt", None), ("Law", "copy.txt", "é\n")]


def listed(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f), "rb").read() for d, _, names in os.walk(root) for f in names if not f.endswith(".crc")}


def frame(spark, rows):
    return spark.createDataFrame(rows, "category string, file_name string, text string").repartition(3)


def test_save_and_replace(spark, tmp_path):
    root = f"{tmp_path}/out"
    tree_writer.save(frame(spark, ROWS), root)
    assert listed(root) == {(f"{c}/" if c else "") + n: (t or "").encode() for c, n, t in ROWS}
    assert os.listdir(tmp_path) == ["out"]
    with pytest.raises(Exception, match="mode overwrite"):
        tree_writer.save(frame(spark, ROWS[:1]), root, overwrite=False)
    tree_writer.save(frame(spark, ROWS[:1]), f"file://{root}")
    assert list(listed(root)) == ["Art/a%41 b (1).txt"]
    tree_writer.save(frame(spark, ROWS[:1]).limit(0), root)
    assert listed(root) == {} and os.listdir(tmp_path) == ["out"]


@pytest.mark.parametrize("bad", [("a/../b", "n.txt", "x"), ("Law", None, "x")])
def test_a_failed_task_leaves_nothing(spark, tmp_path, bad):
    root = f"{tmp_path}/out"
    tree_writer.save(frame(spark, ROWS[:2]), root)
    before = listed(root)
    with pytest.raises(Exception, match="not a file of the tree"):
        tree_writer.save(frame(spark, [*ROWS, bad]), root)
    assert listed(root) == before and os.listdir(tmp_path) == ["out"]


def test_sample_with_damaged_files(spark, tmp_path):
    """Damaged files use no quota, however many come first; odd names are read."""
    root = f"{tmp_path}/in"
    texts = {f"{'abc'[i % 3]}/deep/f [{i}] {{%41}} ({i}).txt": b"ok %d" % i for i in range(60)}
    bad = {name: i % 3 != 0 for i, name in enumerate(sorted(texts))}
    rows = [(n.rpartition("/")[0], n.rpartition("/")[2], bytearray(b"\xff\xfe" if bad[n] else c)) for n, c in texts.items()]
    tree_writer.save(spark.createDataFrame([*rows, ("a", "no.IGNORE", bytearray(b"x"))], "category string, file_name string, content binary"), root)
    order = sorted(texts, key=lambda n: int(hashlib.md5(f"7:{n}".encode()).hexdigest()[:15], 16))
    for n in (0, 1, 5, 20, 21, 100):
        want = [(x, texts[x].decode()) for x in order if not bad[x]][:n]
        assert sorted(tuple(r) for r in corpus.sample(spark, root, n, seed=7).collect()) == sorted(want)


def test_files_and_order(spark, tmp_path):
    tree_writer.save(frame(spark, ROWS), f"{tmp_path}/in")
    tree = corpus.files(spark, f"{tmp_path}/in", recursive=True)
    assert {r["file_name"]: r["length"] for r in tree.collect()} == {n: len(t.encode()) for _, n, t in ROWS if t}
    assert [r["relative"] for r in corpus.ordered(tree, f"{tmp_path}/in").orderBy("ord").collect()] == ["root.txt", "Art/a%41 b (1).txt", "Art/Old/[x] {y}.txt", "Law/copy.txt"]
    assert {r["file_name"] for r in corpus.scan(spark, f"{tmp_path}/in").select(F.col("file_name")).collect()} == {"a%41 b (1).txt", "copy.txt"}


@pytest.mark.parametrize("category, name", [("Law", "../up.txt"), ("Law", ""), ("", "n.txt"), ("/a", "n"), ("a", "b\\c"), ("a//b", "n"), (".", "n"), (None, None)])
def test_names_that_lead_elsewhere(category, name):
    with pytest.raises(ValueError):
        tree_writer.checked(category, name)


def test_no_file_of_a_tree_goes_through_the_driver(spark, tmp_path):
    """Neither an index of the files nor a task for each few of them; a folder's name may hold the root's."""
    root = f"{tmp_path}/in"
    rows = [(f"c{i % 3}/in", f"f{i} {{a}}.{'txt' if i % 2 else 'md'}", f"t{i}") for i in range(120)] + [("Berlin", "x_y=%41.txt", "b"), ("Berlin", "_hidden.txt", "no"), ("_old", "o.txt", "o")]
    tree_writer.save(frame(spark, rows), root)
    want = {(c, n, t) for c, n, t in rows if n[0] != "_" and n.endswith("txt")}
    some = corpus.scan(spark, root)
    assert {tuple(r) for r in some.collect()} == {x for x in want if "/" not in x[0]}
    tree = corpus.files(spark, root, recursive=True)
    deep = corpus.opened(tree.select(F.col("path").substr(len(root) + 2, 999).alias("relative"), "length"), root)
    for df in (some, tree, deep):
        assert not any("/in/" in f for f in df.inputFiles()) and df.rdd.getNumPartitions() < 60
    shown = {f"{c}/{n}": t.encode() for c, n, t in rows if n[0] != "_" and c[0] != "_"}
    assert {r["relative"]: bytes(r["content"]) for r in deep.collect()} == shown
    assert {r["relative"] for r in corpus.ordered(tree, root).collect()} == set(shown)
    assert {r["file_name"] for r in corpus.scan(spark, root, "{x*,q}.[st]xt").collect()} == {"x_y=%41.txt"}
    assert {tuple(r) for r in corpus.scripts(spark, root, "in", "*.txt").collect()} == {(c[:2], n, t) for c, n, t in want if "/" in c}
    with pytest.raises(FileNotFoundError):
        corpus.files(spark, f"{tmp_path}/none")
