"""Judgment pages into numbered paragraphs.

Two layouts are known; the parser is the standard library's, run row by row on executors, and yields plain rows. What follows (cleaning,
numbering, keys) is DataFrame work. A page that breaks the layout's rules gives one row with its error, and the job goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean
from ..storage import PARAGRAPHS
from . import paragraphs as P

# What tells layouts and error pages apart, and the classes of their parts.
ERROR_PAGE = "None of the requests returned"
ANCHOR = "C01PointnumeroteAltN"
TITLES = ('class="coj-sum-title-1"', 'class="sum-title-1"')
HEADING, OPERATIVE = "Titre", "Disposit"
NARROW = ("5%", "95%")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "li": {"li"}}


class Element:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def elements(self) -> Iterator[Element]:
        return (c for c in self.children if isinstance(c, Element))

    def walk(self, without: Element | None = None) -> Iterator[Element | str]:
        """All that lies inside, in the page's order, however deep; what lies in `without` is left out."""
        waiting = self.children[::-1]
        while waiting:
            c = waiting.pop()
            if c is without:
                continue
            yield c
            if isinstance(c, Element):
                waiting += c.children[::-1]

    def every(self, tag: str) -> Iterator[Element]:
        return (c for c in self.walk() if isinstance(c, Element) and c.tag == tag)

    def text(self, without: Element | None = None) -> str:
        return "".join(c for c in self.walk(without) if isinstance(c, str))

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def same(self, other: Element) -> bool:
        """Equal in structure, as two prints of one element are."""
        waiting: list[tuple[Element | str, Element | str]] = [(self, other)]
        while waiting:
            a, b = waiting.pop()
            if isinstance(a, str) or isinstance(b, str):
                if a != b:
                    return False
            elif a.tag != b.tag or a.attrs != b.attrs or len(a.children) != len(b.children):
                return False
            else:
                waiting += zip(a.children, b.children)
        return True


class Tree(HTMLParser):
    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        while self.now.parent and self.now.tag in CLOSES.get(tag, ()):
            self.now = self.now.parent
        made = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(made)
        if tag not in VOID:
            self.now = made

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Element(tag, {k: v or "" for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        at = self.now
        while at.parent and at.tag != tag:
            at = at.parent
        if at.parent:
            self.now = at.parent

    def handle_data(self, data):
        self.now.children.append(data)


def layout(page: str | None) -> int:
    """0 for error pages and unknown ones, else the layout's number. The anchor class decides before the titles."""
    if not page or ERROR_PAGE in page:
        return 0
    return 2 if ANCHOR in page else 1 if any(t in page for t in TITLES) else 0


def table_rows(page: str) -> Iterator[tuple[str | None, str, bool]]:
    """(number, text, is_header) of layout 1: tables directly in the body; those without a 5% or 95% column continue the row before."""
    body = next(Tree(page).root.every("body"), None)
    for table in [] if body is None else (t for t in body.elements() if t.tag == "table"):
        # A parser that repairs markup puts rows into a tbody; columns count only as direct children.
        cols = [c for c in table.elements() if c.tag == "col"]
        row = next(table.every("tr"), None)
        cells = [] if row is None else [c.text().strip() for c in row.elements() if c.tag == "td"]
        if len(cols) > 2 or not any(c.attrs.get("width") in NARROW for c in cols):
            for text in cells:
                yield None, text, False
        else:
            yield cells[0], cells[1], True


def anchor_rows(page: str) -> Iterator[tuple[str | None, str, bool]]:
    """(number, text, is_header) of layout 2: numbered anchors with what follows up to the next one, then the operative part."""
    root = Tree(page).root
    anchors = [p for p in root.every("p") if p.classes() == [ANCHOR] or ANCHOR in p.classes()]
    for i, anchor in enumerate(anchors):
        content = [anchor]
        if not anchor.same(anchors[-1]):
            following = [e for e in anchor.parent.elements()]
            following = following[next(k for k, e in enumerate(following) if e is anchor) + 1 :]
            for e in following:
                if e is anchors[i + 1] or e.same(anchors[i + 1]):
                    break
                if e.classes() and HEADING not in e.classes()[0]:
                    content.append(e)
            else:
                raise ValueError(f"the anchor after number {i + 1} is no sibling of it")
        number, text = None, ""
        for e in content:
            said = e.text().strip()
            if ANCHOR in e.classes():
                link = next(e.every("a"), None)
                if link is not None:
                    number, said = link.text(), e.text(link).strip()
                elif found := re.match(r"\d+", said):
                    number, said = found[0], said[found.end() :]
            text += said + "  "
        numbered = number is not None and number.isnumeric()
        yield number if numbered else None, text, numbered
    for p in root.every("p"):
        if any(OPERATIVE in c for c in p.classes()):
            yield "", p.text().strip(), True


def extract(pages: DataFrame, id_col: str = "celex", body_col: str = "body") -> DataFrame:
    """(celex, seq, para_num, text, is_header, error, layout, page): raw rows of every page of a known layout; others give none.

    body: text or UTF-8 bytes; bytes that aren't UTF-8, and pages that break their layout, give one row with the error. page: a hash of the body.
    """

    def rows_of(body: object) -> tuple[list[tuple], str | None, int]:
        try:
            page = body.decode("utf-8") if isinstance(body, bytes) else body
            kind = layout(page)
            return list((table_rows, anchor_rows)[kind - 1](page)) if kind else [], None, kind
        except (ValueError, IndexError, KeyError, RecursionError) as e:
            return [], f"{type(e).__name__}: {e}", 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            out = []
            for ident, body, page in zip(*(part.column(c).to_pylist() for c in range(3))):
                found, error, kind = rows_of(body)
                if error:
                    out.append((ident, 0, None, None, False, error, None, page))
                out += [(ident, k, number, text, head, None, kind, page) for k, (number, text, head) in enumerate(found)]
            cols = list(zip(*out)) if out else [()] * 8
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["celex", "seq", "para_num", "text", "is_header", "error", "layout", "page"])

    schema = "celex string, seq int, para_num string, text string, is_header boolean, error string, layout int, page long"
    return pages.select(F.col(id_col).cast("string"), F.col(body_col), F.xxhash64(body_col)).mapInArrow(run, schema)


def case_paragraphs(pages: DataFrame, id_col: str = "celex", body_col: str = "body", process: bool = True, operative: bool = False) -> DataFrame:
    """(celex, key, text, seq) of all pages; use paragraphs.articles() for one text a document.

    Layout 1 pages start at paragraph 1 and lose dash and signature rows; the operative part of layout 2 takes the number before it. Pages with
    errors and unknown pages give no rows: extract() has the errors. Of several pages with one id one counts, repeats or not, decided by hash.
    """
    rows = extract(pages, id_col, body_col).where("error is null").withColumn("_one", F.max("page").over(Window.partitionBy("celex")))
    rows = rows.where(F.col("page") == F.col("_one")).dropDuplicates(["celex", "seq"])
    rows = P.merge_continuations(rows, keep=("layout",))
    tables = P.from_first_paragraph(P.without_marks(rows.where("layout = 1")))
    rows = tables.unionByName(rows.where("layout = 2")).select(*[c for c in PARAGRAPHS.names if c != "error"])
    if process:
        rows = rows.withColumn("text", clean(F.col("text")))
    keys = P.keyed(P.fill_numbers(rows))
    return P.operative_only(keys) if operative else keys
