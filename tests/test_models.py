"""Operators that SQL can't state, against plain models written from their rules."""

import os
import random

import pytest

from loomtext.functions import repair
from loomtext.functions import text as T
from loomtext.operators import bpe, dedup, lines, numbering, recurrences, search, synthesis
from loomtext.sources import corpus
from loomtext.streaming import monitor
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark, sf):
    """Texts of the table, and some that overlap by construction."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rng = random.Random(5)
    base = rows[3][1] * 2
    for i in range(60):
        a = rng.randrange(len(base) - 400)
        rows.append((10_000 + i, rng.choice(["", "fresh words " * rng.randrange(20)]) + base[a : a + rng.randrange(20, 400)]))
    return rows, spark.createDataFrame(rows, "ord long, text string")


@pytest.mark.parametrize("width", [100, 30])
def test_precise(docs, width):
    seen, want = set(), {}
    for i, t in sorted(docs[0]):
        keep = []
        for p in range(max(1, len(t) - width + 1)):
            if (w := t[p : p + width]) not in seen:
                seen.add(w)
                keep.append(p)
        out, end = "", 0
        for p in keep:
            out += t[max(p, end) : p + width]
            end = p + width
        want[i] = (out + (t[end:] if len(t) - end > width // 10 else "")) if keep else t[:width]
    assert {r["ord"]: r["text"] for r in dedup.precise(docs[1], width).collect()} == want


@pytest.mark.parametrize("threshold", [0.8, 0.3, 0.0])
def test_greedy(docs, threshold):
    seen, want = set(), {}
    for i, t in sorted(docs[0]):
        own = [t] if len(t) < 100 else [t[p : p + 100] for p in range(0, len(t) - 99, 25)]
        want[i] = sum(w in seen for w in own) / len(own) < threshold
        if want[i]:
            seen.update(own)
    assert {r["ord"]: r["kept"] for r in dedup.greedy(docs[1], 100, threshold).collect()} == want


def test_join_wrapped(spark):
    def joined(*texts, mode=""):
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        return [r["text"] for r in lines.joined(rows, mode).orderBy("doc_id").collect()]

    text = "This line of prose is long enough to be taken as a wrapped line of a paragraph\nand it goes on here without an end, for long enough that nobody takes it for verse,\nto the end of it.\n\nHEADING\n    some verse\nBudget: 5 dollars and something more that makes this line longer than sixty characters"
    out, empty, blank, none, verse = joined(text, "", "a\n\nb", None, "    roses\n    violets\n  \n        sugar and")
    out = out.split("\n")
    assert out[0].startswith("This line") and out[0].endswith("end of it.") and out[1:3] == ["", "HEADING"] and len(out) == 5
    assert (empty, blank, none) == ("", "a\n\nb", None)
    assert verse == "    roses violets\n  \n        sugar and"  # all indented: verse is what differs from a neighbour
    long = "An open line that is longer than ninety characters, which nothing in it closes but its end – ABC\nHEADING"
    assert joined(long) == [long] and joined(long, mode=lines.ENCYCLOPEDIA) == [long.replace("\n", " ")]
    assert joined("(in brackets and over thirty of them)\n  next line here  ", mode=lines.FACTBOOK) == ["(in brackets and over thirty of them) next line here  "]


def test_newline_policies(spark):
    """Run lengths 0 to 20 against the tables of the rules."""
    df = spark.range(21).select("id", F.concat(F.lit("a"), F.repeat(F.lit("\n"), F.col("id").cast("int")), F.lit("b")).alias("t"))
    for name, lengths in T.NEWLINE_POLICIES.items():
        for r in df.select("id", T.newline_policy(F.col("t"), lengths).alias("o")).collect():
            n = r["id"]
            assert r["o"] == ("ab" if n == 0 else "a" + ("\n" * lengths[min(n, 6) - 1] or " ") + "b"), (name, n)
    runs = {1: " ", 2: "\n"} | dict.fromkeys(range(3, 7), "\n" * 2) | dict.fromkeys(range(7, 13), "\n" * 3) | dict.fromkeys(range(13, 17), "\n" * 4)
    for r in df.filter("id between 1 and 16").select("id", T.newline_cascade(F.col("t")).alias("o")).collect():
        assert r["o"] == f"a{runs[r['id']]}b", r["id"]


def plain_merges(texts, vocabulary, target=None, min_frequency=1, min_gain=0.0):
    """Pairs counted anew for each merge; of equals the first inserted wins."""
    words = {}
    for t in texts:
        for i, w in enumerate(x for x in (t or "").split(" ") if x):
            words[w if i == 0 else bpe.MARK + w] = words.get(w if i == 0 else bpe.MARK + w, 0) + 1
    table = {w: list(w) for w in words}
    symbols, out = {c for w in words for c in w}, []
    tokens = chars = sum(len(w) * n for w, n in words.items())
    while len(symbols) < vocabulary:
        pairs = {}
        for w, n in words.items():
            for p in zip(table[w], table[w][1:]):
                pairs[p] = pairs.get(p, 0) + n
        if not pairs:
            break
        best = max(pairs, key=pairs.get)
        n = pairs[best]
        if n < min_frequency or (target is not None and (tokens / chars <= target or (len(symbols) > 1000 and n / tokens < min_gain))):
            break
        out.append(best)
        symbols.add("".join(best))
        tokens -= n
        for w, old in table.items():
            new, i = [], 0
            while i < len(old):
                if tuple(old[i : i + 2]) == best:
                    new.append(old[i] + old[i + 1])
                    i += 2
                else:
                    new.append(old[i])
                    i += 1
            table[w] = new
    return out


def merges(df):
    return [(r["left"], r["right"]) for r in df.orderBy("rank").collect()]


@pytest.mark.parametrize("words", [500_000, 0])
def test_bpe(spark, words):
    """On the driver and on the cluster, ties and all."""
    texts = ["low lower lowest newest newest aaaa", "newest  low aaa", None, "", "wider é😀 é😀"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.train(docs, 24, max_words=words)
    assert merges(got) == plain_merges(texts, 24)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(docs, got)).collect()}
    assert back == {0: texts[0], 1: "newest low aaa", 2: "", 3: "", 4: texts[4]}


def test_bpe_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    assert merges(bpe.train(docs, 200)) == plain_merges(texts, 200)
    assert merges(bpe.train(docs, 50_000, target=0.6, min_frequency=2, min_gain=0.001)) == plain_merges(texts, 50_000, 0.6, 2, 0.001)


def test_numbers_and_totals(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 5).alias("v"))
    got = numbering.numbered(df, ["k"], "n", 10).collect()
    assert {r["n"] - 10: r["k"] for r in got} == {k: k for k in range(5000)}
    v = {r["k"]: r["v"] for r in df.collect()}
    sums, at = {}, 0
    for k in range(5000):
        sums[k], at = at, at + v[k]
    assert {r["k"]: r["before"] for r in numbering.totals_before(df, ["k"], "v", "before").collect()} == sums


@pytest.mark.parametrize("size", [200_000, 3])
def test_substring_counts(spark, size):
    texts, words = ["Aaaa banana BANANA", None, "", "ananan"], ["a", "aa", "ana", "nan", "zz", "ana", "", "banana"]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    w = spark.createDataFrame([(x,) for x in words], "word string")
    got = {r["word"]: r["matches"] for r in search.substring_counts(t, w, pass_words=size).collect()}
    assert got == {x: sum((t or "").lower().count(x) for t in texts) for x in set(words) if x}


def test_window_holders(docs, monkeypatch):
    monkeypatch.setattr(search, "HOT", 3)
    own = {i: {t[p : p + 100] for p in range(0, max(len(t) - 99, 1), 25)} for i, t in docs[0]}
    first = {}
    for i in sorted(own):
        for w in own[i]:
            first.setdefault(w, i)
    want = {}
    for i, ws in own.items():
        for w in ws:
            want[i, first[w]] = want.get((i, first[w]), 0) + 1
    assert {(r["ord"], r["holder"]): r["windows"] for r in search.window_holders(docs[1]).collect()} == want


def test_dedup_modes(docs):
    stats = {m: dedup.statistics(docs[1], m).first() for m in ("precise", "efficient")}
    wins = [t[p : p + 100] for _, t in docs[0] for p in range(max(len(t) - 99, 1))]
    assert (stats["precise"]["seen"], stats["precise"]["kept"]) == (len(wins), len(set(wins)))
    assert stats["efficient"]["seen"] == len(docs[0]) and dedup.deduplicate(docs[1]).count() == stats["efficient"]["kept"]


def test_cubic_fit(spark):
    import numpy as np

    points = [(x / 10, 2 - x / 5 + (x / 10) ** 3 + (x % 3)) for x in range(40)]
    got = recurrences.polynomial_fit(spark.createDataFrame(points, "x double, y double"), "x", "y", 3).orderBy("power").collect()
    assert np.allclose([r["coefficient"] for r in got], np.polyfit(*zip(*points), 3)[::-1], atol=1e-6)


def test_cubic_fit_of_large_x(spark):
    """The coefficients aren't cut where powers of x differ by many digits."""
    points = spark.range(6000).selectExpr("id / 10D AS x", "50 - 0.25D * (id / 10D) + 0.002D * pow(id / 10D, 2) - 0.00001D * pow(id / 10D, 3) + id % 2 AS y")
    got = [r["coefficient"] for r in recurrences.polynomial_fit(points, "x", "y", 3).orderBy("power").collect()]
    assert got == pytest.approx([50.5, -0.25, 0.002, -0.00001], abs=1e-3)


def test_private_use_characters(spark):
    df = spark.createDataFrame([("a\ue000b\n\nc",)], "t string")
    for lengths in T.NEWLINE_POLICIES.values():
        assert df.select(T.newline_policy(F.col("t"), lengths)).first()[0].startswith("a\ue000b")


def test_arithmetic(spark):
    """Every operation, form and kind occurs; results are those of Python's operators."""
    made = lambda: sorted(synthesis.arithmetic(synthesis.choices(spark, 3000, 1)).collect(), key=lambda r: r["id"])
    rows = made()
    assert rows == made() and len(rows) == 3000 and {r["op"] for r in rows} == set(synthesis.OPS)
    ops = {"ADD": lambda a, b: a + b, "SUBTRACT": lambda a, b: a - b, "MULTIPLY": lambda a, b: a * b, "DIVIDE": lambda a, b: a // b if b else None}
    for r in rows:
        assert r["result"] == ops[r["op"]](r["a"], r["b"])
        assert str(r["a"]) in r["question"] and str(r["b"]) in r["question"] and r["question"][-1] in ".?!"
        assert ("undefined" if r["result"] is None else str(r["result"])) in r["answer"] and "{" not in r["question"] + r["answer"]
        if r["op"] != "DIVIDE":
            assert max(abs(r["a"]), abs(r["b"])) <= 99999
    for f in synthesis.FORMS:
        head = f.text.split("{")[0]
        assert any(r["question"].startswith(head) for r in rows)
    assert any(r["op"] == "DIVIDE" and r["b"] and r["a"] % r["b"] for r in rows) and any(r["a"] < 0 for r in rows)
    assert max(len(str(abs(r["b"]))) for r in rows if r["op"] == "ADD") == 5


def test_repair():
    assert repair.fix("cafÃ© &amp; “tea”\r\nﬁne\x00") == 'café & "tea"\nfine'
    assert repair.fix("cafÃ©") == "café" == repair.fix("cafÃƒÂ©") and repair.fix("itâ€™s") == "it's"
    assert repair.fix("żółw cafÃ©") == "żółw café" and repair.fix("ＡＢ１　x\x1b[31mred") == "AB1 xred"
    assert repair.fix("Ünïcödé déjà") == "Ünïcödé déjà"


def test_unwrap(spark):
    cases = {"x" * 60 + "\n\n" + "y" * 45 + "\nz": "x" * 60 + "\n" + "y" * 45 + " z", "a\n\nb\n": "a\n\nb\n", "": "", "\n\n" + "x" * 55 + "\n\n" + "y" * 40 + "\n": "\n" + "x" * 55 + "\n" + "y" * 40 + " "}
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert [r for r in df.select(T.unwrap(F.col("text")).alias("got"), "want").collect() if r["got"] != r["want"]] == []


def test_tree(spark, tmp_path):
    for c in ("Art- Old", "Law"):
        os.makedirs(tmp_path / "in" / c)
        for i in range(3):
            (tmp_path / "in" / c / f"Work {c} ({i}).txt").write_text(f"text {i}\nmore")
        (tmp_path / "in" / c / "skip.IGNORE").write_text("no")
    tree = corpus.scan(spark, str(tmp_path / "in"))
    assert tree.count() == 6 and {r["category"] for r in tree.collect()} == {"Art- Old", "Law"}
    assert corpus.files(spark, str(tmp_path / "in"), recursive=True).count() == 8
    raw = spark.createDataFrame([(bytearray(b"plain\r\nx"),), (bytearray("é".encode()),)], "content binary")
    assert {r["text"] for r in corpus.decode_bytes(raw).collect()} == {"plain\nx", "├⌐"}


def test_stream(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    q = monitor.first_seen(stream, "user_id", delay="3650 days").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("seen").count() == events.select("user_id").distinct().count()
