"""Pages as element trees, however malformed their markup.

A page is read once, left to right. Start tags open an element; an end tag closes
the innermost open element of its name with all that stand open inside it, and is
ignored if there is none; nothing is closed by implication, so an unclosed
``<p>`` goes on to the end of what surrounds it. What script and style hold, and
comments, are no markup. Elements are numbered in the order of their start tags,
and each knows the last number inside it, so that a subtree is a range of numbers.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

#: Elements without content, and elements whose content isn't markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
#: A comment, an end tag, a start tag, or a declaration. Quotes in a start tag may hide ``>``.
_MARK = re.compile(r"""<!--.*?(?:-->|\Z)|</([a-zA-Z][^\s/>]*)[^>]*>|<([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|["'=])*?)>|<[!?][^>]*>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?""")


class Tree:
    """A page's elements: tag, attributes, parent (-1 at the top) and last number inside;
    its pieces of text, each with the element it stands in and the next element's number."""

    __slots__ = ("tags", "heads", "parents", "ends", "closed", "pieces", "after", "owners", "by_tag")

    def __init__(self, page: str):
        self.tags: list[str] = []
        self.heads: list[str] = []
        self.parents: list[int] = []
        self.ends: list[int] = []
        self.closed: list[bool] = []
        self.pieces: list[str] = []
        self.after: list[int] = []
        self.owners: list[int] = []
        self.by_tag: dict[str, list[int]] = {}
        open_: list[int] = []
        count: dict[str, int] = {}  # open elements by tag: an end tag without one costs nothing
        at = 0

        def close(to: int) -> None:
            for i in open_[to:]:
                self.ends[i] = len(self.tags) - 1
                count[self.tags[i]] -= 1
            del open_[to:]

        while (m := _MARK.search(page, at)) is not None:
            self._text(page[at : m.start()], open_)
            at = m.end()
            if m[1] is not None:
                name = m[1].lower()
                if count.get(name):
                    to = len(open_) - 1
                    while self.tags[open_[to]] != name:
                        to -= 1
                    self.closed[open_[to]] = True
                    close(to)
            elif m[2] is not None:
                name, own = m[2].lower(), len(self.tags)
                self.tags.append(name)
                self.heads.append(m[3])
                self.parents.append(open_[-1] if open_ else -1)
                self.ends.append(own)
                self.by_tag.setdefault(name, []).append(own)
                single = name in VOID or m[3].endswith("/")
                self.closed.append(single)
                if not single:
                    open_.append(own)
                    count[name] = count.get(name, 0) + 1
                    if name in RAW:
                        end = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
                        at = end.start() if end else len(page)
        self._text(page[at:], open_)
        close(0)

    def _text(self, piece: str, open_: list[int]) -> None:
        if piece:
            self.pieces.append(piece)
            self.owners.append(open_[-1] if open_ else -1)
            self.after.append(len(self.tags))

    def attributes(self, node: int) -> dict[str, str]:
        """Names in lower case; of repeated ones the last; without a value empty."""
        return {m[1].lower(): html.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(self.heads[node])}

    def path(self, node: int) -> str:
        parts = []
        while node >= 0:
            parts.append(self.tags[node])
            node = self.parents[node]
        return "/".join(reversed(parts))

    def depths(self) -> list[int]:
        out: list[int] = []
        for p in self.parents:
            out.append(1 if p < 0 else out[p] + 1)
        return out

    def inside(self, node: int, tag: str) -> list[int]:
        """Elements of a tag in a node's subtree (-1: the page), in order."""
        own = self.by_tag.get(tag, [])
        end = self.ends[node] if node >= 0 else len(self.tags)
        return own[bisect_right(own, node) : bisect_right(own, end)]

    def next_sibling(self, node: int, tag: str) -> int | None:
        """The first later child of the same parent that has a tag."""
        return next((i for i in self.inside(self.parents[node], tag) if i > node and self.parents[i] == self.parents[node]), None)

    def text(self, node: int) -> str:
        """The pieces of text in a subtree, each stripped, in a row; scripts and styles don't count."""
        end = self.ends[node]
        out = []
        for k in range(bisect_right(self.after, node), len(self.pieces)):
            if self.after[k] > end + 1:
                break
            up = self.owners[k]
            if self.after[k] == end + 1 and not node <= up <= end:
                break  # behind the subtree
            if up < 0 or self.tags[up] not in RAW:
                out.append(html.unescape(self.pieces[k]).strip())
        return "".join(out)


def listed_links(page: str, section: str, header: str) -> Iterator[tuple[int, str, str]]:
    """(item, href, title): in the first ``div`` of a class the ``h2`` of an id, the next
    ``ol`` beside it, and of each ``li`` in that the first link, if both are there (C22)."""
    tree = Tree(page)
    box = next((i for i in tree.inside(-1, "div") if section in tree.attributes(i).get("class", "").split()), None)
    if box is None:
        return
    head = next((i for i in tree.inside(box, "h2") if tree.attributes(i).get("id") == header), None)
    if head is None:
        return
    found = tree.next_sibling(head, "ol")
    if found is None:
        return
    links = tree.by_tag.get("a", [])
    for n, li in enumerate(tree.inside(found, "li"), 1):
        k = bisect_left(links, li)
        if k < len(links) and links[k] <= tree.ends[li]:
            href, title = tree.attributes(links[k]).get("href", ""), tree.text(links[k])
            if href and title:
                yield n, href, title
