"""Index records against the whole file split in Python, over splits of all sizes."""

import random

import pytest

from loomtext.sources import index


def plain(text):
    """id: name of the first entry with it, by the rules, paragraph by paragraph."""
    out = {}
    for p in text.split("\n\n"):
        if p.startswith(" "):
            continue
        line = next((x for x in p.split("\n") if x), "")
        tail = line[-10:].replace(" ", "")
        if not (tail.isdecimal() and tail.isascii() and line.endswith("   " + tail)):
            continue
        ext = ".IGNORE" if "[Language: " in p and "English" not in p else ".txt"
        out.setdefault(int(tail), f"{line.split('   ')[0]} ({tail}){ext}")
    return out


def made(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.randrange(8)
        title = "Tïtle " + "word " * rng.randrange(30) + "x"
        gap = " " * rng.choice([1, 2, 3, 12, 40])
        note = rng.choice(["", "\n [Language: French]", "\n [Language: English]", "\n [Language: German]\n English notes", "\n by Z"])
        out.append({0: f" carries on   {i}", 1: "~ heading ~", 2: f"{title}   12x{i}"}.get(kind, f"{title}{gap}{i % 500:0{rng.choice([1, 6])}d}{note}"))
    return out


@pytest.mark.parametrize("size, extra", [(97, ""), (1000, "\n"), (1 << 20, "\n\n")])
def test_splits(spark, tmp_path, size, extra):
    records = made(700, size)
    text = ("\n\n" + extra).join(records)
    (tmp_path / "index.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = index.records(spark, str(tmp_path / "index.txt"))
        parts = rows.rdd.getNumPartitions()
        got = {r["id"]: r["name"] for r in index.entries(rows).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 100 if size == 97 else parts >= 1
    want = plain(text)
    assert got == want and len(want) > 100


def test_lookup(spark, tmp_path):
    index.save(spark.createDataFrame([("A by B" + " " * 9 + "7\nmore",), ("C" + " " * 12 + "8\n[Language: French]",), ("near  9",)], "record string"), f"{tmp_path}/i")
    wanted = spark.createDataFrame([(7,), (8,), (9,), (7,), (None,)], "work_id long")
    got = sorted((tuple(r) for r in index.lookup(spark, f"{tmp_path}/i", wanted).collect()), key=str)
    assert got == [(7, "A by B (7).txt"), (8, "C (8).IGNORE"), (9, None)]
