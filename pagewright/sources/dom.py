"""The tree of a page's elements, for what patterns can't give: nesting, attributes, text."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .treebuilder import Node, build

SCHEMA = "idx int, parent int, depth int, last int, tag string, attrs map<string,string>, text string, content string, above array<int>, error string"
_ARROW = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
#: Elements after which a batch goes on; characters of an element's content that are kept, as many as any rule looks at.
ROWS, CONTENT = 5000, 240
#: Fixed value: white space in page text, as in functions/text.py.
_BLANK = "\t\n\x0b\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Runs of it but for single blanks, which may stay; characters of a text that mostly hold CONTENT characters of it.
_RUN, _AHEAD = re.compile(f"[ {_BLANK}][ {_BLANK}]+|[{_BLANK}]"), 1000


def _begun(text: str) -> str:
    """The first CONTENT + 2 characters of a text, blanks as one."""
    out = _RUN.sub(" ", text[:_AHEAD])
    if len(text) > _AHEAD and len(out) <= CONTENT + 2:  # a run may go on
        out = _RUN.sub(" ", text)
    return out[: CONTENT + 2]


def numbered(root: Node) -> list[tuple]:
    """The rows of a tree's elements in document order, but for the error."""
    rows: list[list] = []
    pieces: list[str] = []  # of text, blanks as one; each cut, as no content needs more of it
    sizes: list[int] = []
    spans: list[list[int]] = []
    todo: list[tuple] = [(root, None)]
    while todo:
        node, parent = todo.pop()
        if node is None:  # an element ends here
            rows[parent][3] = len(rows) - 1
            spans[parent][1] = len(pieces)
            continue
        if isinstance(node, str):
            piece = _begun(node)
            pieces.append(piece)
            sizes.append(len(piece.strip(" ")))
            continue
        me = len(rows)
        above = [] if parent is None else [*rows[parent][8], parent]
        own = _RUN.sub(" ", "".join([k for k in node.kids if isinstance(k, str)])).strip(" ") if node.kids else ""
        rows.append([me, parent, len(above), me, node.tag, list(node.attrs.items()), own, None, above])
        spans.append([len(pieces), 0])
        todo.append((None, me))
        todo += [(k, me) for k in reversed(node.kids)]
    for row, (first, end) in zip(rows, spans):
        last, size = first, 0
        while last < end and size <= CONTENT:
            size += sizes[last]
            last += 1
        text = pieces[first] if last == first + 1 else _RUN.sub(" ", "".join(pieces[first:last]))
        row[7] = text.strip(" ")[:CONTENT] or text[:1]
    return [tuple(r) for r in rows]


def dom_rows(pages: DataFrame, parse: Callable[[str], Node] = build) -> DataFrame:
    """page_id and SCHEMA of every element of pages (page_id, html); a null html has none, an empty one what every page has.

    last is the largest idx inside an element, so idx..last spans it and its descendants; above: its ancestors, from the
    root on; text: its own text; content: the first CONTENT characters of all text inside it, white space as one blank (a blank alone if there is nothing else). A page
    that can't be parsed has one row, with the error and nothing else.
    """
    kind = dict(pages.dtypes)["page_id"]
    names = ["page_id", *(f.split()[0] for f in SCHEMA.split(", "))]

    def run(batches):
        for b in batches:
            page, rows = [], []

            def batch():
                columns = list(zip(*rows)) or [()] * len(_ARROW)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(page, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, _ARROW))], names=names)

            for i, html in enumerate(b.column(1).to_pylist()):
                if html is None:
                    continue
                try:
                    found = [(*r, None) for r in numbered(parse(html))]
                except Exception as e:  # one page's fault is its own row, not the job's end
                    found = [(*[None] * 9, f"{type(e).__name__}: {e}")]
                page += [i] * len(found)
                rows += found
                if len(rows) >= ROWS:
                    yield batch()
                    page, rows = [], []
            if rows:
                yield batch()

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, {SCHEMA}")


def dom_elements(pages: DataFrame) -> DataFrame:
    """The elements of dom_rows, pages that can't be parsed left out."""
    return dom_rows(pages).where("error IS NULL").drop("error")


def with_descendants(elements: DataFrame, wanted: dict[str, Column], most: int = 4) -> DataFrame:
    """Elements (page_id, idx, last; whole pages) with how many wanted descendants each has, at most `most`, by name.

    A running count of wanted elements is taken at the last element inside one and at itself. Of the elements that end with the same one
    this has the largest count, so two windows are enough; both are within a page.
    """
    run, ends = W.partitionBy("page_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0), W.partitionBy("page_id", "last")
    counted = elements.withColumns({f"_{n}": F.count_if(c).over(run) for n, c in wanted.items()})
    return counted.withColumns({n: F.least(F.max(f"_{n}").over(ends) - F.col(f"_{n}"), F.lit(most)) for n in wanted}).drop(*[f"_{n}" for n in wanted])


def descendant_counts(elements: DataFrame, wanted: Column, most: int = 4) -> DataFrame:
    """page_id, idx and n, how many wanted descendants each element (page_id, idx, last) has, at most `most`."""
    return with_descendants(elements, {"n": wanted}, most).select("page_id", "idx", "n")
