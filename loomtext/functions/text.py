"""String functions as Column expressions; all stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it; Java's class lacks the four separators.
SPACE = r"\s\x1c-\x1f"

#: Newlines that a run of 1, 2, ... newlines becomes (0: a space);
#: the last entry stands for all longer runs.
NEWLINE_POLICIES = {
    "C6": (0, 1, 1, 2, 2, 3),
    "C7": (0, 1, 2, 3, 4, 5),
    "C8": (1, 1, 2, 3, 4, 5),
    "C9": (0, 1, 2, 3, 3, 3),
    "C10": (0, 0, 1, 2, 3, 4),
}


def collapse_spaces(text: Column) -> Column:
    """Runs of U+0020 become one space."""
    return F.regexp_replace(text, " +", " ")


def flatten_white_space(text: Column) -> Column:
    """Each white-space character becomes a space."""
    return F.regexp_replace(text, f"(?U)[{SPACE}]", " ")


def tidy_tabs(text: Column) -> Column:
    """A space after a tab goes, then one before a tab; one pass each."""
    return F.replace(F.replace(text, F.lit("\t "), F.lit("\t")), F.lit(" \t"), F.lit("\t"))


def newline_cascade(text: Column, five: int = 4, more: int = 5) -> Column:
    """Lone newlines become spaces; then runs shrink by literal replacements, each
    working on what the one before left (C4; C5 with five = more = 3)."""
    text = F.regexp_replace(text, r"(?<!\n)\n(?!\n)", " ")
    for old, new in ((2, 1), (3, 2), (4, 3), (5, five)):
        text = F.replace(text, F.lit("\n" * old), F.lit("\n" * new))
    return F.regexp_replace(text, r"\n{6,}", "\n" * more)


def newline_policy(text: Column, lengths: tuple[int, ...]) -> Column:
    """Each run of newlines becomes the policy's (C6-C10). Runs that become a space go
    first; of the others, in one pass, a group keeps the newlines that stay."""
    last = len(lengths)
    run = lambda n: f"\n{{{n},}}" if n == last else f"\n{{{n}}}"
    for n in (n for n in range(1, last + 1) if not lengths[n - 1]):
        text = F.regexp_replace(text, f"(?<!\n){run(n)}(?!\n)", " ")
    kept = [(n, lengths[n - 1]) for n in range(1, last + 1) if lengths[n - 1]]
    either = "|".join(f"(\n{{{stay}}})\n{{{n - stay}{',' if n == last else ''}}}" for n, stay in kept)
    return F.regexp_replace(text, f"(?<!\n)(?:{either})(?!\n)", "".join(f"${i + 1}" for i in range(len(kept))))


#: Fixed value: what a wrapped passage looks like, as ``\n*.{55,}\n\n.{40,}\n`` finds it. It can only
#: start with newlines or where a line starts, and no line is tried at every later place.
WRAPPED = "(?:\n+|(?<![^\n]))[^\n]{55,}+\n\n[^\n]{40,}+\n"


def unwrap(text: Column) -> Column:
    """Newline runs inside passages that look wrapped, by their length."""
    passages = F.regexp_extract_all(text, F.lit(WRAPPED), F.lit(0))
    shorter = lambda p: newline_policy(p, NEWLINE_POLICIES["C6"])
    return F.array_join(F.zip_with(F.split(text, WRAPPED, -1), passages, lambda between, p: F.concat(between, F.coalesce(shorter(p), F.lit("")))), "")


def newline_single_pass(text: Column, lengths: tuple[int, ...]) -> Column:
    """The policy without the last character, which the single pass loses (C11)."""
    return newline_policy(F.substring(text, F.lit(1), F.length(text) - 1), lengths)


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text, F.lit(f"(?U)[^{SPACE}]+")).cast("long")


def file_name(text: Column) -> Column:
    """A title as a file name: forbidden characters deleted, white space runs one
    space, trimmed, 200 characters, never empty (C15)."""
    text = F.regexp_replace(text, r'[<>:"/\\|?*]', "")
    text = F.trim(F.regexp_replace(text, f"(?U)[{SPACE}]+", " "))
    return F.coalesce(F.nullif(F.left(text, F.lit(200)), F.lit("")), F.lit("untitled"))


def strip_comments(text: Column) -> Column:
    """Without the lines that start with #."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~x.startswith("#"))
    return F.array_join(lines, "\n")


def work_id(name: Column) -> Column:
    """What stands in the last parentheses before the extension."""
    return F.substring_index(F.substring_index(name, ").txt", 1), "(", -1)


def title(entry: Column) -> Column:
    """Of "title by author" the title; with more "by", the part before the last (C20)."""
    parts = F.split(entry, " by ", -1)
    return F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise(parts[0])


def between(text: Column, start: str, end: str) -> Column:
    """What stands between the first ``start`` and the next ``end``, or null."""
    rest = F.substring(text, F.instr(text, start) + len(start), F.length(text))
    return F.when((F.instr(text, start) > 0) & (F.instr(rest, end) > 0), F.substring_index(rest, end, 1))


def encode_characters(text: Column, ids: Mapping[str, int], unknown: int) -> Column:
    """Characters as ids of a fixed alphabet."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.coalesce(F.try_element_at(table, c), F.lit(unknown)))


def decode_ids(ids: Column, tokens: Mapping[int, str]) -> Column:
    """Ids as text, ``?`` for those the table lacks."""
    table = F.create_map(*[F.lit(x) for kv in tokens.items() for x in kv])
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(table, i), F.lit("?"))), "")


def word_tokens(text: Column, empty: bool = False) -> Column:
    """Words with the single spaces between them as tokens of their own, between
    begin and end marks; ``empty`` keeps the words between adjoining spaces (C25)."""
    words = F.split(text, " ", -1)
    each = F.flatten(F.transform(words, lambda w, i: F.when(i == 0, F.array(w)).otherwise(F.array(F.lit(" "), w))))
    return F.concat(F.array(F.lit("<BOS>")), each if empty else F.filter(each, lambda w: w != ""), F.array(F.lit("<EOS>")))


def encode_words(tokens: Column, ids: Mapping[str, int], length: int, unknown: str = "<UNK>", padding: str = "<PAD>") -> Column:
    """Ids of word tokens: those the vocabulary lacks get the unknown mark's, and
    shorter sequences are filled on the right up to ``length`` (C25)."""
    table = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    known = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), F.lit(ids[unknown])))
    return F.concat(known, F.array_repeat(F.lit(ids[padding]), F.greatest(F.lit(length) - F.size(known), F.lit(0))))


def display(token: Column) -> Column:
    """One printable line of at most 40 characters."""
    shown = F.replace(F.replace(token, F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    return F.when(F.length(shown) > 40, F.concat(F.left(shown, F.lit(37)), F.lit("..."))).otherwise(shown)


def document(text: Column, newlines: bool = True) -> Column:
    """A text between begin, end and separator marks."""
    gap = "\n" if newlines else ""
    return F.concat(F.lit(f"<BOS>{gap}"), text, F.lit(f"{gap}<EOS><SEP>"))


#: The license markers, with the newlines that a text may have between
#: their lines, and how many newline cascades follow; in the order in which they are tried.
_FILE_NOTE = "***** This file should be named"
LICENSE_FOOTERS = (
    ("START: FULL LICENSE\nTHE FULL PROJECT GUTENBERG LICENSE\nPLEASE READ THIS BEFORE YOU DISTRIBUTE OR USE THIS WORK", 0),
    ("START: FULL LICENSE\n\nTHE FULL PROJECT GUTENBERG LICENSE\n\nPLEASE READ THIS BEFORE YOU DISTRIBUTE OR USE THIS WORK", 1),
    ("START: FULL LICENSE\n\n\nTHE FULL PROJECT GUTENBERG LICENSE\n\n\nPLEASE READ THIS BEFORE YOU DISTRIBUTE OR USE THIS WORK", 2),
    ("START: FULL LICENSE\n\n\n\nTHE FULL PROJECT GUTENBERG LICENSE\n\n\n\nPLEASE READ THIS BEFORE YOU DISTRIBUTE OR USE THIS WORK", 3),
)
LICENSE_HEADERS = (
    ("If you are not located in the United States, you will have to check the laws of the country where you are located before using this eBook.", 0),
    ("If you are not located in the United States,\nyou will have to check the laws of the country where you are located\nbefore using this eBook.", 1),
    ("If you are not located in the United States,\n\nyou will have to check the laws of the country where you are located\n\nbefore using this eBook.", 2),
    ("If you are not located in the United States,\n\n\nyou will have to check the laws of the country where you are located\n\nbefore using this eBook.", 3),
    ("You may copy it, give it away or re-use it under the terms of the Project Gutenberg License included with this eBook or online at www.gutenberg.org", 0),
    ("You may copy it, give it away or\nre-use it under the terms of the Project Gutenberg License included\nwith this eBook or online at www.gutenberg.org", 1),
    ("You may copy it, give it away or\n\nre-use it under the terms of the Project Gutenberg License included\n\nwith this eBook or online at www.gutenberg.org", 2),
    ("You may copy it, give it away or\n\n\nre-use it under the terms of the Project Gutenberg License included\n\n\nwith this eBook or online at www.gutenberg.org", 3),
)
LICENSE_UPDATES = (
    ("Updated editions will replace the previous one—the old editions will be renamed.\n\nCreating the works from print editions not protected by U.S. copyright law means that no one owns a United States copyright in these works", 1),
    ("Updated editions will replace the previous one—the old editions will be renamed.\n\n\nCreating the works from print editions not protected by U.S. copyright law means that no one owns a United States copyright in these works", 2),
)


def trim_license(text: Column) -> Column:
    """A work without the license before and after it (C14). A text that no marker
    touched gets the newline cascade twice, a note about the file name aside."""

    def settle(t: Column, times: int) -> Column:
        for _ in range(times):
            t = newline_cascade(t, 3, 3)
        return t

    text = F.substring_index(tidy_tabs(collapse_spaces(text)), _FILE_NOTE, 1)
    touched = F.lit(False)
    for markers, part in ((LICENSE_FOOTERS, 0), (LICENSE_HEADERS, 1), (LICENSE_UPDATES, 0)):
        out, found = text, F.lit(False)
        for marker, times in reversed(markers):
            has = F.contains(text, F.lit(marker))
            out = F.when(has, settle(F.split_part(text, F.lit(marker), F.lit(part + 1)), times)).otherwise(out)
            found = found | has
        text, touched = out, touched | found
    return F.when(touched, text).otherwise(settle(text, 2))


def tidy_question(text: Column) -> Column:
    """Double spaces single, trimmed, ended by one mark."""
    t = F.btrim(F.replace(text, F.lit("  "), F.lit(" ")), F.lit(" \n\t\r"))
    t = F.when(F.right(t, F.lit(1)).isin(*".?!"), t).when(F.contains(t, F.lit("?")), F.concat(t, F.lit("?"))).otherwise(F.concat(t, F.lit(".")))
    return F.when(F.right(t, F.lit(2)).isin("..", "??"), F.left(t, F.length(t) - 1)).otherwise(t)
