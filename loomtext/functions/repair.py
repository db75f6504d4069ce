"""Text repair (C12): what the standard library can do of it."""

from __future__ import annotations

import functools
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame

from loomtext.sources.shared import small

#: Quotes straightened and ligatures spelt out.
PLAIN = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"}
_CONTROL = re.compile("[\x00-\x08\x0b\x0e-\x1f\x7f\ufeff]")
_TERMINAL = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
#: Full-width forms of ASCII, and the wide space.
_NARROW = {0xFF01 + i: 0x21 + i for i in range(94)} | {0x3000: 0x20}
#: Control characters that code page 1252 has printable ones for.
_C1 = {i: bytes([i]).decode("cp1252") for i in range(0x80, 0xA0) if i not in (0x81, 0x85, 0x8D, 0x8F, 0x90, 0x9D)}


#: Code pages that UTF-8 may have been read by, the likelier first.
PAGES = ("cp1252", "latin-1", "cp1251", "cp1250", "cp1253", "cp1254", "cp1255", "cp1256", "cp1257")
#: Blocks whose characters texts commonly have, as ranges.
_USUAL = ((0xA0, 0x17F), (0x370, 0x3FF), (0x400, 0x45F), (0x490, 0x491), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x1E00, 0x1EFF), (0x2010, 0x2044), (0x20A0, 0x20BF), (0x2100, 0x2122), (0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3), (0x1F300, 0x1FAFF))
#: How odd a character of a category is inside a text; others are 4.
_ODDS = {"Ll": 1, "Lu": 1, "Lo": 1, "Lm": 1, "Mn": 1, "Nd": 1, "Zs": 2, "Po": 2, "Pd": 2, "Pi": 2, "Pf": 2, "Cc": 8, "Cn": 8, "Co": 8}


def _page(name: str) -> tuple[dict[str, int], re.Pattern]:
    """The bytes of a page's characters, and what UTF-8 sequences look like when it has read
    them. Bytes that the page lacks are read as the control characters they number."""
    chars = []
    for byte in range(0x80, 0x100):
        try:
            chars.append(bytes([byte]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(byte))
    of = lambda first, last: "[" + "".join(map(re.escape, chars[first - 0x80 : last - 0x7F])) + "]"
    more = of(0x80, 0xBF)
    return {c: 0x80 + i for i, c in enumerate(chars)}, re.compile(f"(?:{of(0xC2, 0xDF)}{more}|{of(0xE0, 0xEF)}{more}{{2}}|{of(0xF0, 0xF4)}{more}{{3}})+")


_READ = [_page(name) for name in PAGES]


@functools.lru_cache(4096)
def _kind(char: str) -> tuple[int, str]:
    """How odd a character is, and the script of a letter."""
    category, at = unicodedata.category(char), ord(char)
    odd = _ODDS.get(category, 4) + (0 if at < 0x80 or any(lo <= at <= hi for lo, hi in _USUAL) else 4)
    return odd, unicodedata.name(char, "?").split()[0] if category[0] == "L" else ""


def oddness(text: str) -> int:
    """The weight of a reading: its characters', and more where scripts meet in a word or a
    capital follows a small letter."""
    total, last, small = 0, "", False
    for char in text:
        odd, script = _kind(char)
        total += odd + 4 * bool(script and last and script != last) + 2 * (small and char.isupper())
        last, small = script, char.islower()
    return total


def _unmangled(text: str) -> str:
    """Without UTF-8 that was read by another page, however often. Each stretch that may be
    such is read by all pages, and the least odd reading stays, the text itself among them.
    A page is trusted in a text by what it gains there beyond shorter stretches: it wins
    ties, and readings that are only shorter need a page with such a gain elsewhere."""
    while not text.isascii():
        found, trust = [], [0] * len(_READ)
        for order, (codes, sequences) in enumerate(_READ):
            for m in sequences.finditer(text):
                try:
                    new = bytes(codes[c] for c in m.group()).decode("utf-8")
                except UnicodeDecodeError:
                    continue
                a, b = m.span()
                before, after = text[max(0, a - 1) : a], text[b : b + 1]
                gain = oddness(before + m.group() + after) - oddness(before + new + after)
                beyond = gain - (b - a - len(new))
                if gain > 0:
                    found.append((a, b, gain, beyond > 0, order, new))
                    trust[order] += max(0, beyond)
        out, end = [], 0
        for a, b, _, _, _, new in sorted((x for x in found if x[3] or trust[x[4]]), key=lambda x: (x[0], -x[2], -trust[x[4]], x[4])):
            if a >= end:
                out += [text[end:a], new]
                end = b
        if not out:
            return text
        text = "".join([*out, text[end:]])
    return text


def fix(text: str) -> str:
    """Mojibake, entities (where there is no tag), terminal escapes, quotes, ligatures,
    character widths, control characters, line ends and NFC (C12)."""
    text = _unmangled(text)
    if "<" not in text:
        text = html.unescape(text)
    text = _TERMINAL.sub("", text).replace("\r\n", "\n").translate(dict.fromkeys(map(ord, "\r\x85\u2028\u2029"), "\n"))
    text = text.translate(_C1 | _NARROW).translate(str.maketrans(PLAIN))
    return unicodedata.normalize("NFC", _CONTROL.sub("", text))


def mapped(docs: DataFrame, f) -> DataFrame:
    """(doc_id, text) with ``f`` on each text; null stays null. A worker holds the results of
    a few texts at once."""

    def run(batches):
        for b in small(batches):
            out = pa.array([None if t is None else f(t) for t in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string")
