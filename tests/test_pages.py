"""Element trees and listed links against a parser built on the standard library's."""

import random
from html.parser import HTMLParser

import pytest

from loomtext.functions import markup
from loomtext.operators import pages

SOUP = [
    "<div>", "<div class='page_content'>", '<DIV CLASS="x page_content y">', "</div>", "<h2 id=top>", "<h2 id='top' class=z>", "</h2>", "<ol>", "</ol>", "<ul>", "</ul>", "<li>", "</li>", "<li class=\"a>b\">",
    '<a href="/ebooks/12">', "<a href='/x?a=1&amp;b=2'>", "<a>", "<a href=>", "</a>", "One by Two", " text &amp; more ", "é", "\n ", "<br>", "<br/>", "<img src=x>", "<!-- <li> </ol> -->", "</p>", "<p>",
    '<script>var t="</p><li>";</script>', "<style>p{}</style>", "<b>", "</b>", "</nothing>", "<span/>", "a < b",
]

ITEMS = ["<li>", "</li>", '<a href="/ebooks/12">', "</a>", "One by Two", "<b>", " \n"]


class Plain(HTMLParser):
    """Nodes as objects, by the parser of the standard library."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = self.now = {"tag": "", "attrs": {}, "kids": [], "up": None}
        self.all = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs, single=False):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": [], "up": self.now}
        self.now["kids"].append(node)
        self.all.append(node)
        if tag not in markup.VOID and not single:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs, True)

    def handle_endtag(self, tag):
        node = self.now
        while node is not self.top and node["tag"] != tag:
            node = node["up"]
        if node is not self.top:
            self.now = node["up"]
        self.now["kids"].append("")  # texts on both sides stay apart

    def handle_comment(self, data):
        self.now["kids"].append("")

    def handle_data(self, data):
        kids = self.now["kids"]
        if kids and isinstance(kids[-1], str) and kids[-1]:
            kids[-1] += data
        else:
            kids.append(data)


def under(node, tag):
    for k in node["kids"]:
        if isinstance(k, dict):
            if k["tag"] == tag:
                yield k
            yield from under(k, tag)


def text(node):
    if node["tag"] in ("script", "style"):
        return ""
    return "".join(k.strip() if isinstance(k, str) else text(k) for k in node["kids"])


def plain_links(page):
    tree = Plain(page)
    box = next((d for d in under(tree.top, "div") if "page_content" in d["attrs"].get("class", "").split()), None)
    head = box and next((h for h in under(box, "h2") if h["attrs"].get("id") == "top"), None)
    if not head:
        return []
    kids = [k for k in head["up"]["kids"] if isinstance(k, dict)]
    ol = next((k for k in kids[[id(k) for k in kids].index(id(head)) + 1 :] if k["tag"] == "ol"), None)
    out = []
    for n, li in enumerate(under(ol, "li") if ol else [], 1):
        a = next(under(li, "a"), None)
        if a and a["attrs"].get("href") and text(a):
            out.append((n, a["attrs"]["href"], text(a)))
    return out


def walked(node, depth=1, path=""):
    for k in node["kids"]:
        if isinstance(k, dict):
            yield depth, path + k["tag"], k["attrs"]
            yield from walked(k, depth + 1, path + k["tag"] + "/")


@pytest.mark.parametrize("seed", range(4))
def test_soup(seed):
    """Random markup, mostly malformed; every second page has a listed section in it."""
    rng = random.Random(seed)
    hits = 0
    for n in range(400):
        page = "".join(rng.choices(SOUP, k=rng.randint(0, 40)))
        if n % 2:
            page = '<div class="page_content">' + "".join(rng.choices(SOUP[-12:], k=3)) + "<h2 id=top>T</h2>" + "".join(rng.choices(SOUP[-12:], k=3)) + "<ol>" + "".join(rng.choices(ITEMS, k=8)) + page
        tree = markup.Tree(page)
        got = [(d, tree.path(i), tree.attributes(i)) for i, d in enumerate(tree.depths())]
        assert got == list(walked(Plain(page).top)), page
        assert list(markup.listed_links(page, "page_content", "top")) == plain_links(page), page
        hits += bool(plain_links(page))
    assert hits > 10


def test_tables_pages(spark, sf):
    """Pages as they are: unclosed paragraphs, tags in scripts."""
    table = spark.read.parquet(f"{sf}/pages.parquet")
    got = {}
    for r in pages.elements(table).orderBy("page_id", "node").collect():
        got.setdefault(r["page_id"], []).append((r["depth"], r["path"], dict(r["attributes"])))
    for r in table.collect():
        assert got[r["page_id"]] == list(walked(Plain(r["html"]).top))


def test_ends_and_long_pages():
    tree = markup.Tree("<p>a<b>c<p>d</b>e" + "<li>x" * 30000 + "</p>tail")
    assert tree.tags[:3] == ["p", "b", "p"] and tree.parents[:4] == [-1, 0, 1, 0]
    assert tree.ends[0] == len(tree.tags) - 1 and tree.ends[1] == 2 and tree.closed[:3] == [True, True, False]
    page = '<div class=page_content><h2 id=top></h2><ol>' + "<li><a href=/e/%d>T</a>" * 1 % 7 + "<li>" * 20000 + "<a href=x>y</a></ol></div>"
    assert sum(1 for _ in markup.listed_links(page, "page_content", "top")) == 20001
    assert markup.Tree("<a href='x").tags == [] and markup.Tree("").tags == []


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "no markup"), (None, "<p>x")], "page_id long, html string")
    assert [(r["page_id"], r["tag"], r["closed"]) for r in pages.elements(df).collect()] == [(None, "p", False)]
    assert pages.listed_links(df, "a", "b").count() == 0
    links = spark.createDataFrame([(1, 1, "/e/5", "A"), (1, 2, "/e/6", "T by U by V"), (1, 3, "/e/5", "B by C")], "page_id long, item int, href string, title string")
    assert sorted(tuple(r) for r in pages.catalog(links, "/e/").collect()) == [(1, "5", "B"), (1, "6", "U")]
