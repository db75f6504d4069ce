"""Tables of what pages hold: elements, and the links of a listed section."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions import markup

#: Rows that a batch of results holds, about.
ROWS = 10_000


def _each(pages: DataFrame, id_col: str, html_col: str, found, schema: str) -> DataFrame:
    """Rows ``found(page)`` of every page behind its id; a null page has none."""
    ids = dict(pages.dtypes)[id_col]

    def run(batches):
        for b in batches:
            own, rows = [], []
            kind = b.schema.field(0).type
            for i, page in zip(b.column(0).to_pylist(), b.column(1)):
                for row in found(page.as_py() or ""):
                    own.append(i)
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield batch(own, rows, kind)
                        own, rows = [], []
            if rows:
                yield batch(own, rows, kind)

    def batch(own, rows, kind):
        return pa.RecordBatch.from_arrays([pa.array(own, kind), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [f.strip().rsplit(" ", 1) for f in schema.split(";")]
    types, names = [kinds[t] for _, t in fields], [id_col, *(n for n, _ in fields)]
    return pages.select(F.col(id_col), F.col(html_col).cast("string")).mapInArrow(run, ", ".join([f"`{id_col}` {ids}", *(f"{n} {t}" for n, t in fields)]))


def elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, node, parent, last, depth, tag, path, closed, attributes): a row an element,
    in the order of start tags from 0; ``last`` is the last node inside, so descendants
    join by a range of nodes; ``closed`` tells whether it has an end tag of its own."""

    def found(page):
        tree = markup.Tree(page)
        for i, depth in enumerate(tree.depths()):
            yield i, tree.parents[i], tree.ends[i], depth, tree.tags[i], tree.path(i), tree.closed[i], list(tree.attributes(i).items())

    return _each(pages, id_col, html_col, found, "node int; parent int; last int; depth int; tag string; path string; closed boolean; attributes map<string,string>")


def listed_links(pages: DataFrame, section: str, header: str, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, item, href, title) of a page's listed section."""
    return _each(pages, id_col, html_col, lambda page: markup.listed_links(page, section, header), "item int; href string; title string")


def catalog(links: DataFrame, marker: str) -> DataFrame:
    """(page_id, work_id, name): the id behind a marker in the link and the name before
    " by "; of links to one work the last counts."""
    work = F.element_at(F.split("href", marker, -1), -1)
    parts = F.split("title", " by ", -1)
    name = F.when(F.size(parts) > 2, F.element_at(parts, -2)).otherwise(parts[0])
    own = links.groupBy("page_id", work.alias("work_id")).agg(F.max_by(name, "item").alias("name"))
    return own.select("page_id", "work_id", "name")
