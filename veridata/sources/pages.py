"""Web pages table (page_id, url, html) → paragraph text and HTML tables.

Parsing HTML needs a tokenizer, so these two operators run as
``mapInPandas`` over Arrow batches: each task parses its own pages with the
standard-library parser and emits rows; counts and filters afterwards are
ordinary Spark aggregations.
"""

from __future__ import annotations

from html.parser import HTMLParser
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values
MIN_PARAGRAPH_CHARS = 20      # keep <p> whose stripped text is longer than this
EXCERPT_CHARS = 1500
MIN_TABLE_ROWS = 3
MIN_TABLE_COLS = 2
BLOCK_TAGS = {"p", "div", "table", "ul", "ol", "li", "section", "article", "header", "footer", "nav",
              "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "body", "html"}
SKIP_TAGS = {"script", "style", "template", "noscript"}


MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534  # limits of the HTML standard
CELLS_AT_ONCE = 50_000                  # cells of a result batch


def _span(attrs, name: str, most: int) -> int:
    text = (dict(attrs).get(name) or "").strip()
    return min(max(int(text), 1), most) if text.isdecimal() else 1


class _Table:
    """An open table. A cell ends with the next cell, a row with the next row or section,
    whether they are closed or not."""

    def __init__(self):
        self.rows: list[list[tuple]] = []
        self.in_row, self.cell = False, None

    def open_row(self):
        self.close_row()
        self.rows.append([])
        self.in_row = True

    def open_cell(self, is_header: bool, across: int, down: int):
        self.close_cell()
        if not self.in_row:
            self.open_row()
        self.cell = (is_header, across, down, [])

    def close_cell(self):
        if self.cell is not None:
            is_header, across, down, data = self.cell
            self.rows[-1].append((is_header, across, down, " ".join("".join(data).split())))
            self.cell = None

    def close_row(self):
        self.close_cell()
        self.in_row = False

    def grid(self):
        """Rows with cells as (all are headers, texts), one at a time; spanning cells are
        repeated in every place."""
        hanging: dict[int, tuple[int, str]] = {}  # column -> (rows left, text)
        for row in filter(None, self.rows):
            texts: dict[int, str] = {c: text for c, (_, text) in hanging.items()}
            hanging = {c: (left - 1, text) for c, (left, text) in hanging.items() if left > 1}
            at = 0
            for _, across, down, text in row:
                for _ in range(across):
                    while at in texts:
                        at += 1
                    texts[at] = text
                    if down > 1:
                        hanging[at] = (down - 1, text)
            yield all(cell[0] for cell in row), [texts.get(c, "") for c in range(max(texts) + 1)]

    @property
    def holds_text(self) -> bool:
        return any(cell[3] for row in self.rows for cell in row)

    def shape(self) -> tuple[list[str] | None, int, int]:
        """(texts of the first header row, number of data rows, width of the data rows)."""
        head, count, width = None, 0, 0
        for is_header, texts in self.grid():
            if is_header:
                head = texts if head is None else head
            else:
                count, width = count + 1, max(width, len(texts))
        return head, count, width


class _Extractor(HTMLParser):
    """Collects paragraph texts and tables in one pass over a page.

    A ``<p>`` left open closes at the next block tag (stated difference:
    a lenient parser would nest the following paragraph inside it).
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.paragraphs: list[str] = []
        self._p: list[str] | None = None
        self._skip = 0
        self._all: list[_Table] = []   # in the order of their start tags
        self._open: list[_Table] = []  # innermost last

    def _close_p(self):
        if self._p is not None:
            self.paragraphs.append("".join(self._p).strip())
            self._p = None

    def handle_starttag(self, tag, attrs):
        if tag in SKIP_TAGS:
            self._skip += 1
            return
        if tag in BLOCK_TAGS:
            self._close_p()
        if tag == "p":
            self._p = []
        elif tag == "table":
            self._open.append(_Table())
            self._all.append(self._open[-1])
        elif self._open and tag == "tr":
            self._open[-1].open_row()
        elif self._open and tag in ("thead", "tbody", "tfoot"):
            self._open[-1].close_row()
        elif self._open and tag in ("td", "th"):
            self._open[-1].open_cell(tag == "th", _span(attrs, "colspan", MAX_COLSPAN), _span(attrs, "rowspan", MAX_ROWSPAN))

    def handle_endtag(self, tag):
        if tag in SKIP_TAGS:
            self._skip = max(0, self._skip - 1)
            return
        if tag == "p":
            self._close_p()
        elif self._open and tag in ("td", "th"):
            self._open[-1].close_cell()
        elif self._open and tag in ("tr", "thead", "tbody", "tfoot"):
            self._open[-1].close_row()
        elif self._open and tag == "table":
            self._open.pop().close_row()

    def handle_data(self, data):
        if self._skip:
            return
        if self._p is not None:
            self._p.append(data)
        for table in self._open:  # a cell also has the text of the tables in it
            if table.cell is not None:
                table.cell[-1].append(data)

    def close(self):
        super().close()
        self._close_p()
        while self._open:
            self._open.pop().close_row()

    @property
    def filled(self) -> list[_Table]:
        """Tables that hold text, in document order."""
        return [t for t in self._all if t.holds_text]

    @property
    def tables(self) -> list[list[tuple[bool, list[str]]]]:
        return [list(t.grid()) for t in self.filled]


def _parse(html: str) -> _Extractor:
    p = _Extractor()
    p.feed(html or "")
    p.close()
    return p


def page_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """(page_id, text): paragraphs longer than 20 stripped characters joined by
    a space. The whole page is used unless ``max_chars`` asks for a cut."""
    def run(batches):
        for b in batches:
            texts = []
            for h in b["html"]:
                t = " ".join(x for x in _parse(h).paragraphs if len(x) > MIN_PARAGRAPH_CHARS)
                texts.append(t[:max_chars] if max_chars else t)
            yield pd.DataFrame({"page_id": b["page_id"], "text": texts})
    return pages.select("page_id", "html").mapInPandas(run, "page_id long, text string")


def page_tables(pages: DataFrame) -> DataFrame:
    """Long form of every valid table (≥ 3 data rows, ≥ 2 columns):
    (page_id, table_no, row_no, col_no, header, cell). ``table_no`` is the place
    among all tables of the page that hold text; the header row (all ``<th>``) names
    the columns. End tags may be missing, nested tables are tables of their own, and
    cells that span rows or columns are repeated. A task holds ``CELLS_AT_ONCE`` cells at a time."""
    names = ["page_id", "table_no", "row_no", "col_no", "header", "cell"]

    def cells(pid, html):
        for k, found in enumerate(_parse(html).filled):
            head, count, width = found.shape()
            if count < MIN_TABLE_ROWS or width < MIN_TABLE_COLS:
                continue
            heads = [(head[j] if head and j < len(head) else str(j)) for j in range(width)]
            for i, row in enumerate(texts for is_header, texts in found.grid() if not is_header):
                for j in range(width):
                    yield pid, k, i, j, heads[j], row[j] if j < len(row) else None

    def run(batches):
        for b in batches:
            every = (c for pid, h in zip(b["page_id"], b["html"]) for c in cells(pid, h))
            while some := list(islice(every, CELLS_AT_ONCE)):
                yield pd.DataFrame(some, columns=names)
    schema = "page_id long, table_no int, row_no int, col_no int, header string, cell string"
    return pages.select("page_id", "html").mapInPandas(run, schema)


def first_table(pages: DataFrame, page_id: int) -> tuple[int, DataFrame] | None:
    """(number, rows) of a page's first valid table, a column per header; None without one."""
    cells = page_tables(pages.where(F.col("page_id") == page_id))
    heads = cells.where("row_no = 0").groupBy("table_no").agg(
        F.sort_array(F.collect_list(F.struct("col_no", "header"))).alias("h")).orderBy("table_no").first()
    if heads is None:
        return None
    names, no = [h["header"] for h in heads["h"]], heads["table_no"]
    wide = cells.where(F.col("table_no") == no).groupBy("row_no").pivot("col_no", list(range(len(names)))).agg(F.first("cell"))
    return no, wide.orderBy("row_no").drop("row_no").toDF(*[
        n if names[:i].count(n) == 0 else f"{n}_{names[:i].count(n) + 1}" for i, n in enumerate(names)])


def save_first_table(pages: DataFrame, page_id: int) -> str | None:
    """Keep a page's first valid table as the view ``Web:<page>_t<number>``; its name."""
    from .tables import save_view
    found = first_table(pages, page_id)
    if found is None:
        return None
    url = pages.where(F.col("page_id") == page_id).select("url").first()["url"] or ""
    base = url.split("?")[0].rsplit("/", 1)[-1] or "web_data"
    return save_view(found[1], f"Web:{base}_t{found[0]}")


def table_counts(long_tables: DataFrame) -> DataFrame:
    """(page_id, table_no, rows, cols) from the long form."""
    return long_tables.groupBy("page_id", "table_no").agg(
        F.countDistinct("row_no").alias("rows"), F.countDistinct("col_no").alias("cols"))


def page_excerpt(pages: DataFrame, n: int = EXCERPT_CHARS) -> DataFrame:
    """(page_id, excerpt, html_chars): the first n characters as a preview,
    with the length of the whole page."""
    return pages.select("page_id", F.substring("html", 1, n).alias("excerpt"),
                        F.length("html").cast("long").alias("html_chars"))
