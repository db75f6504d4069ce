"""Cutting text by the byte-level BPE pattern, and a bounded table of pieces.

The pattern's matches ("pieces") are encoded independently of each other, so a
piece needs encoding once while it stays in a worker's table. Python's own ``re``
cuts several times faster than engines that know ``\\p{L}``; its classes agree
with the pattern's on all characters but those of ``_odd``, and a text that holds
one of these is left to the tokenizer library as a whole.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: The public pattern, written with classes that ``re`` knows.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Pieces that a worker's table holds before it starts anew.
TABLE = 1 << 18


@functools.cache
def _odd() -> re.Pattern:
    """Characters that ``re`` classes otherwise than Unicode's L, N and
    White_Space, those that this Python's Unicode tables don't know, and for speed
    all beyond the basic plane."""
    ranges: list[list[int]] = [[0x10000, sys.maxunicode]]
    for c in range(0x10000):
        ch = chr(c)
        kind = unicodedata.category(ch)
        letter, number = ch.isalnum() and not ch.isdecimal(), ch.isdecimal()
        odd = kind == "Cn" or letter != (kind[0] == "L") or number != (kind[0] == "N") or 0x1C <= c <= 0x1F
        if odd and ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        elif odd:
            ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


_ASCII_ODD = re.compile("[\x1c-\x1f]")


def pieces(text: str) -> list[str] | None:
    """The pattern's matches, in order; None where only the library can tell."""
    if (_ASCII_ODD if text.isascii() else _odd()).search(text):
        return None
    return PIECES.findall(text)


class PieceTable(dict):
    """piece -> value of its Encoding, at most TABLE of them. ``encode_batch`` is
    called for many texts at once: a call costs more than a text."""

    def __init__(self, encode_batch, value):
        super().__init__()
        self._encode, self._value = encode_batch, value

    def learn(self, cut: list[list[str]]) -> None:
        """Afterwards every piece of ``cut`` is in the table."""
        pieces = set().union(*cut)
        new = pieces.difference(self)
        if new and len(self) + len(new) > TABLE:
            self.clear()
            new = pieces
        new = list(new)
        for a in range(0, len(new), 8192):
            part = new[a : a + 8192]
            self.update(zip(part, map(self._value, self._encode(part))))


def runs(texts: list[str], size: int = 1 << 20):
    """Runs of texts of about ``size`` characters together."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
