"""The Merkle manifest against a plain version of its contract."""

import zlib
from collections import defaultdict

import duckdb
import pytest

from loomtext.llm import merkle
from tests.llm.test_against_brute_force import ODD, lower, same, sha


def h(*parts):
    return sha("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def climbed(nodes, fanout):
    """All levels; for each node of the first, its (left, right) by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for k, i in enumerate(at):
            run = runs[i // fanout]
            paths[k].append(("".join(run[: i % fanout]), "".join(run[i % fanout + 1 :])))
        at, level = [i // fanout for i in at], [sha("".join(r)) for r in runs]
    return (level[0] if level else None), paths


def plain(docs, fanout=8):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of rows of the five columns."""
    groups = defaultdict(list)
    for i, source, lang, n, text in docs:
        own = h(i, source, lang, n, text)
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        groups[lang].append((i, own, h(i, source, lang, n, text if text is None else lower(text)) if hit else own))
    subs, out = [], []
    for lang in sorted(groups, key=lambda g: (g is not None, (g or "").encode())):
        rows = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        sub, paths = climbed([r[1] for r in rows], fanout)
        out += [(r, len(subs), p) for r, p in zip(rows, paths)]
        subs.append(sub)
    root, tops = climbed(subs, fanout)
    found = []
    for (i, own, start), s, path in out:
        path, x = path + tops[s], start
        for left, right in path:
            x = sha(left + x + right)
        found.append((i, own, subs[s], root, sha("".join(a + b for a, b in path)), x, x == root))
    return found


def table(spark, sf, kind):
    if kind == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    odd = ODD + [(i, f"Text {i}", None if i % 3 else f"g{i % 40}", "S", i) for i in range(1000, 1150)] + [(2000, "ALONE", "é", None, None)] + [(3000, "Twice A", "en", "a", 1), (3000, "Twice B", "en", "a", 1)]
    return spark.createDataFrame([(*r, 1, {"a": 1}) for r in odd], "doc_id long, text string, lang string, source string, n_chars long, digest int, m map<string,int>")


NAMES = "doc_id leaf subroot root proof_sha256 folded_root verified".split()


@pytest.fixture
def placed(tmp_path):
    """Writes a table where the query reads it."""

    def write(docs):
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return write


@pytest.mark.parametrize("kind", ["table", "odd"])
def test_query(spark, sf, kind, placed):
    docs = table(spark, sf, kind)
    data = [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]
    got = merkle.op12_merkle_manifest(spark, placed(docs))
    want = plain(data)
    assert got.columns == NAMES
    same(got, want)
    assert any(not r[-1] for r in want) and sum(r[-1] for r in want) > len(want) / 2


def test_sql(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = c.execute(merkle.ORACLE)
    assert sorted(d[0] for d in q.description) == sorted(NAMES)
    same(merkle.op12_merkle_manifest(spark, sf).select(*[d[0] for d in q.description]), q.fetchall())


@pytest.mark.parametrize("fanout, sizes", [(2, [1]), (2, [1, 1]), (2, [2, 3, 5, 16, 17]), (3, [27, 28, 1]), (8, [8, 9, 64, 65]), (8, [1] * 70)])
def test_shapes(spark, fanout, sizes):
    """Full and ragged runs, lone leaves, one group and many."""
    data = [(k * 1000 + i, "s", f"g{k:03d}", i, f"T{i}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(data, "doc_id long, source string, lang string, n_chars long, text string")
    made = merkle.build(merkle.row_leaves(docs), fanout)
    got = made.proofs()
    want = [(i, leaf, sub, p) for i, leaf, sub, _, p, _, _ in plain(data, fanout)]
    same(got.select("key", merkle.text_of(got.digest), merkle.text_of(got.subroot), merkle.proof_digest(got.proof)), want)
    assert [r[0].hex() for r in got.select(merkle.fold(got.digest, got.proof)).distinct().collect()] == [made.root.hex()]


def test_empty_table(spark, placed):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.op12_merkle_manifest(spark, placed(none))
    assert got.columns == NAMES and got.count() == 0
