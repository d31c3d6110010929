"""Tables of HTML documents as cells with spans."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.elements import batched
from folioflow.sources.grids import Cell, grid, span
from folioflow.sources.html_pages import ENDED_BY, VOID, hidden

#: Fixed value: elements whose end stands for a space.
SPACED = ("p", "li", "th", "td")

SCHEMA = "doc_id long, table_no int, row int, col int, row_span int, col_span int, column_header boolean, row_header boolean, text string"
_TYPES = (pa.int64(), *[pa.int32()] * 5, pa.bool_(), pa.bool_(), pa.string())


class _Reader(HTMLParser):
    """Rows of the outermost tables. What a cell holds is text, a table in it too; hidden cells are empty, and rows of a table's foot are left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.tables: list[list[list[tuple[str, int, int, str]]]] = []
        self.cell: tuple[int, str, int, int] | None = None  # depth, tag, row span, column span
        self.said: list[str] = []

    def handle_starttag(self, tag: str, attrs) -> None:
        a = dict(attrs)
        while self.open and self.open[-1][0] in ENDED_BY.get(tag, ()):
            self.handle_endtag(self.open[-1][0])
        shut = bool(self.open and self.open[-1][1]) or (tag not in ("thead", "tbody", "tr") and hidden(tag, a))
        if tag == "br" and not shut:
            self.said.append("\n")
        if tag in VOID:
            return
        self.open.append((tag, shut))
        names = [n for n, _ in self.open]
        if names.count("table") != 1 or (shut and tag not in ("td", "th")) or (len(self.open) > 1 and self.open[-2][1]):
            return
        if tag == "table":
            self.tables.append([])
        elif "tfoot" not in names[names.index("table"):]:
            if tag == "tr":
                self.tables[-1].append([])
            elif tag in ("td", "th") and self.cell is None and self.tables[-1]:
                self.cell, self.said = (len(self.open), tag, span(a.get("rowspan")), span(a.get("colspan"))), []

    def handle_endtag(self, tag: str) -> None:
        if all(n != tag for n, _ in self.open):
            return
        while True:
            if self.cell and self.cell[0] == len(self.open):
                _, kind, down, across = self.cell
                self.tables[-1][-1].append((kind, down, across, "".join(self.said).strip()))
                self.cell = None
            name, shut = self.open.pop()
            if name in SPACED and not shut:
                self.said.append(" ")
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if self.cell and not self.open[-1][1]:
            self.said.append(data)


def parse(text: str) -> list[list[Cell]]:
    """The cells of each table of a page that has any; a table in a cell is text of that cell. Tables without rows are left out."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1][0])
    return [cells for cells in (grid([r for r in rows if r]) for rows in reader.tables) if cells]


def cells(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """SCHEMA: cells of the tables of each page. A null or empty page has none; pages are read one by one, and rows go out in batches of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = ((i, t) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = ((i, k, c.row, c.col, c.row_span, c.col_span, c.column_header, c.row_header, c.text) for i, t in docs for k, table in enumerate(parse(t or "")) for c in table)
        return batched(rows, [f.split()[0] for f in SCHEMA.split(", ")], _TYPES, text_at=8)

    return pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, SCHEMA)
