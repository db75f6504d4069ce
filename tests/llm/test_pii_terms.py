"""Terms that disclose an entity: rare entities, copied texts, places far from the entity."""

from loomtext.llm import pii


def cut(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: [texts[r["doc_id"]][t["start"] : t["end"]] for t in r["terms"] or ()] for r in pii.protect(docs).collect()}


def test_entity_of_one_text(spark):
    texts = ["Ask zorblax about boss@corp.example.com today please", *(f"please ask today about nothing{i}" for i in range(200))]
    assert cut(spark, texts)[0] == ["zorblax"]


def test_copies_hide_no_term(spark):
    texts = [f"Ask zorblax about boss@corp.example.com today please {i}" for i in range(3)]
    texts += [texts[0]] * 100 + [f"please ask today about nothing{i}" for i in range(200)]
    got = cut(spark, texts)
    assert all(got[i] == ["zorblax"] for i in range(103))


def test_every_place_of_a_term(spark):
    far = "please ask today about nothing " * 10
    texts = [f"Ask zorblax77 about boss@corp.example.com today please {far} Zorblax77 {i}" for i in range(3)]
    texts += [f"please {far}" for i in range(1)] + [f"please ask today about nothing nothing{i}" for i in range(200)]
    got = cut(spark, texts)
    assert all(got[i] == ["zorblax77", "Zorblax77"] for i in range(3))


def test_overlapping_spans_leave_nothing():
    assert pii._cut("x +1.2.3.4 555 1234 call", "phone:2:19,ip:3:10", None) == "x [PHONE] call"
    assert pii._cut("a b c", "ip:0:1", [{"start": 2, "end": 3}]) == "[IP]  c"


def test_sanitise_odd_rows(spark):
    rows = [(1, None, "d"), (2, "", "d"), (3, "mail me@x.org now", "d"), (3, "mail me@x.org now", "d"), (None, "+1.2.3.4 555 1234 call", "d")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, digest string, base int, terms int, copies int")
    got = sorted(((r["doc_id"], r["text"]) for r in pii.sanitise(docs).collect()), key=repr)
    assert [g for g in got if g[0] == 1] == [(1, None)] and (2, "") in got and (None, "[PHONE] call") in got
    assert [g[1] for g in got if g[0] == 3] == ["mail [EMAIL] now"] * 2 or all("[EMAIL]" in g[1] for g in got if g[0] == 3)


def test_many_spans_in_one_text():
    import time

    text = " ".join(f"word{i} u{i}@x.org" for i in range(40_000))
    began = time.time()
    spans = pii.base_spans(text)
    assert len(spans) == 40_000 and len(pii._context(text, spans)) > 40_000
    assert time.time() - began < 15


def plain_terms(texts):
    """Entities, terms, and which disclose which, from the definition."""
    import math

    distinct = sorted({t or "" for t in texts})
    n = len(distinct)
    df, near, held = {}, {}, {}
    for t in distinct:
        for w in {m.group().lower() for m in pii._TERM.finditer(t)}:
            df[w] = df.get(w, 0) + 1
        spans = pii.base_spans(t)
        inside = [c for a, _, b in spans for c in range(a, b)]
        for a, k, b in spans:
            e = pii.KINDS[k] + ":" + t[a:b].lower()
            held.setdefault(e, set()).add(t)
            for m in pii._TERM.finditer(t):
                s, f = m.span()
                around = (a - pii.WINDOW <= s and f <= a) or (b <= s and f <= b + pii.WINDOW)
                if around and not set(range(s, f)) & set(inside):
                    near.setdefault((e, m.group().lower()), set()).add(t)
    out = set()
    for (e, w), both in near.items():
        texts_e, ic = len(held[e]), math.log2(n / len(held[e]))
        if len(both) >= pii.CERTAIN * texts_e and math.log2(len(both) / (texts_e + 1) / (df[w] / n)) >= pii.DISCLOSED * ic:
            out.add((e, w))
    return out


def test_disclosing_terms_by_brute_force(spark, sf):
    """On the table, with entities that many texts share added to it."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += [f"{t[:80]} zorblax{i % 3} wrote to boss{i % 2}@corp.example.com about it" for i, t in enumerate(texts[:12])]
    texts += [None, "", texts[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pii.materialise(pii.scan(docs), "pii")
    got = {(r["entity"], r["term"]) for r in pii.disclosing(docs, found).collect()}
    assert got == plain_terms(texts) and got
