"""Text repair: UTF-8 read by other code pages, whole texts and stretches of them."""

import pytest

from loomtext.functions import repair

SAMPLES = {
    "cp1250": "Příliš žluťoučký kůň úpěl ďábelské ódy. Zażółć gęślą jaźń",
    "cp1251": "Съешь ещё этих мягких французских булок, да выпей чаю",
    "cp1252": "Voix ambiguë d’un cœur qui préfère les jattes de kiwis – “déjà” €5",
    "cp1253": "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία",
    "cp1254": "Pijamalı hasta yağız şoföre çabucak güvendi",
    "cp1255": "דג סקרן שט בים מאוכזב ולפתע מצא חברה",
    "cp1256": "نص حكيم له سر قاطع وذو شأن عظيم",
    "cp1257": "Įlinkdama fechtuotojo špaga sublykčiojusi pragręžė apvalų arbūzą",
    "latin-1": "Ñandú pingüino, señor; naïve Größe",
}


def mangled(text, page):
    out = ""
    for byte in text.encode():
        try:
            out += bytes([byte]).decode(page)
        except UnicodeDecodeError:
            out += chr(byte)
    return out


@pytest.mark.parametrize("page", SAMPLES)
def test_pages(page):
    text = SAMPLES[page]
    assert repair._unmangled(mangled(text, page)) == text
    assert repair._unmangled(text) == text
    if page in ("cp1252", "latin-1", "cp1251"):
        assert repair._unmangled(mangled(mangled(text, page), page)) == text


def test_stretches():
    """Good and mangled pieces of one text, by different pages."""
    pieces = [SAMPLES["cp1251"], mangled(SAMPLES["cp1252"], "cp1252"), SAMPLES["cp1252"], mangled(SAMPLES["cp1251"], "cp1251"), "plain", mangled("Größe", "latin-1")]
    assert repair._unmangled(" | ".join(pieces)) == " | ".join([SAMPLES["cp1251"], SAMPLES["cp1252"], SAMPLES["cp1252"], SAMPLES["cp1251"], "plain", "Größe"])


@pytest.mark.parametrize("text", ["RENÉ® 10 °C", "Рёв моторов", "ÀÉÎÕÜ àéîõü", "3 × 4 ÷ 2 ± 1", "«voilà»", "ŁÓDŹ łódź", "Ångström’s", "“é”", "日本語テキスト", ""])
def test_good_texts_stay(text):
    assert repair._unmangled(text) == text


def test_a_worker_makes_few_texts_at_once():
    """Batches are cut before texts become Python objects, and keep every row in order."""
    import pyarrow as pa

    from loomtext.sources.shared import small

    given = [pa.RecordBatch.from_arrays([pa.array(range(n))], names=["i"]) for n in (0, 1, 1000)]
    got = list(small(given))
    assert max(b.num_rows for b in got) <= 256 and [x for b in got for x in b.column(0).to_pylist()] == [0, *range(1000)]


def test_windows_are_read_once_and_counted_by_text(spark):
    """A text's equal windows are one row; greedy reads the texts for their windows once."""
    from loomtext.operators import dedup

    docs = spark.createDataFrame([(1, "ab" * 20), (2, None), (3, "ab" * 20 + "c"), (4, "x")], "ord long, text string")
    rows = dedup.counted_windows(docs, 4, 1).collect()
    assert sorted((r["ord"], r["n"]) for r in rows) == [(1, 18), (1, 19), (2, 1), (3, 1), (3, 18), (3, 19), (4, 1)]
    assert len({(r["h"], r["g"]) for r in rows}) == 5
    plan = dedup.greedy(docs, 4)._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow" not in plan and {r["ord"]: r["kept"] for r in dedup.greedy(docs, 4).collect()} == {1: True, 2: True, 3: False, 4: True}
