"""Fill-in-middle against a plain version of its contract."""

import hashlib
import re

import duckdb
import pytest

from loomtext.llm import fim
from tests.llm.test_against_brute_force import ODD, rows, same, sha

AWKWARD = [
    (20, " \t lead and tail \n\n", "en", "a", 0),
    (21, "a\x1fb \x1e\x1e c\x1ed\x1ee \x1f \x1f", "en", "a", 0),
    (22, "\x00 nul \x0b\x0c x\x85y z 😀😀 é", "en", "a", 0),
    (23, "<P", "en", "a", 0),
    (24, "has <S> in it", "en", "a", 0),
    (25, "<<P <S <M< > S> P> M>", "en", "a", 0),
    (26, " " * 500, "en", "a", 0),
    (27, ("word \n" * 40000), "en", "a", 0),
    (28, "x" * 300000, "en", "a", 0),
    *[(i, "one two <S three $1 \\ four", "en", "a", 0) for i in range(100, 140)],
    *[(i, "<", "en", "a", 0) for i in range(200, 230)],
]


def plain(i, t, rate=50, spm=80):
    t = t or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    assert "".join(units) == t
    n = len(units)
    h = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module", params=["table", "odd"])
def docs(request, spark, sf):
    if request.param == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return spark.createDataFrame([(*r, "x", "y", 7) for r in ODD + AWKWARD], "doc_id long, text string, lang string, source string, n_chars long, output string, h string, marked int")


@pytest.mark.parametrize("rate, spm", [(50, 80), (100, 0), (100, 100), (0, 50)])
def test_transform(docs, rate, spm):
    got = fim.transform(docs, rate=rate, spm=spm)
    assert set(docs.columns) <= set(got.columns)
    same(got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output"), [(i, *plain(i, t, rate, spm)) for i, t in rows(docs)])


def test_restored_texts(docs):
    got = fim.transform(docs.select("doc_id", "text"), rate=100)
    same(got.select("doc_id", fim.restored(got.output, got.form)), [(i, t or "") for i, t in rows(docs)])


def test_query(spark, sf):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    q = c.execute(fim.ORACLE)
    names = [d[0] for d in q.description]
    got = fim.op11_fill_in_middle(spark, sf)
    assert sorted(got.columns) == sorted(names)
    same(got.select(*names), q.fetchall())
    data = rows(spark.read.parquet(f"{sf}/documents.parquet"))
    want = [(i, *p[:4], sha(p[4]), sha(t or "")) for i, t in data for p in [plain(i, t)]]
    same(got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"), want)
    assert {r["form"] for r in got.collect()} == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fim.transform(none).count() == 0
    odd = spark.createDataFrame([(1, "a b", "kept", "gone", {"k": 1})], "doc_id long, text string, `row` string, form string, zero map<string,int>")
    got = fim.transform(odd).first().asDict()
    assert got["row"] == "kept" and got["form"] in ("plain", "psm", "spm") and got["zero"] == {"k": 1}
    assert hashlib.sha256(got["text"].encode()).hexdigest() == sha("a b")
