"""Cells of a table in their places, from rows whose cells span several rows or columns."""

from __future__ import annotations

import re
from typing import NamedTuple

#: Fixed value: the largest span of a cell.
MAX_SPAN = 4096


class Cell(NamedTuple):
    row: int
    col: int
    row_span: int
    col_span: int
    column_header: bool
    row_header: bool
    text: str


def span(value: str | None) -> int:
    m = re.match(r"\s*(\d+)", value or "")
    return min(int(m[1]), MAX_SPAN) if m else 1


def grid(rows: list[list[tuple[str, int, int, str]]]) -> list[Cell]:
    """Cells in their places, from rows of (tag, row span, column span, text).

    A row of headers that all reach further down takes no row of its own: its cells stand with the row after it, one row less high.
    A cell takes the first column that no cell of a row above reaches into; what sticks out of the grid is free.
    """
    shared = [all(tag == "th" and down != 1 for tag, down, _, _ in row) for row in rows]
    height, width = shared.count(False), max((sum(c[2] for c in row) for row in rows), default=0)
    if not height or not width:
        return []
    taken: dict[int, list[tuple[int, int]]] = {}  # rows of a column that cells stand in
    out, at, ahead = [], -1, 0
    for row, is_shared in zip(rows, shared, strict=True):
        at, ahead = (at, ahead + 1) if is_shared else (at + 1, 0)
        y, col = at + ahead, 0
        heads = all(tag == "th" for tag, *_ in row)
        for tag, down, across, text in row:
            down -= is_shared
            while col < width and y < height and any(a <= y < b for a, b in taken.get(col, ())):
                col += 1
            for c in range(col, min(col + across, width)):
                taken[c] = [(a, b) for a, b in taken.get(c, ()) if b > at] + [(y, y + down)]
            out.append(Cell(y, col, down, across, heads, not heads and tag == "th", text))
    return out


def filled(cells: list[Cell]) -> list[list[str]]:
    """Rows of texts: each cell's in all its places, the later cell's where two meet."""
    height, width = max((c.row + 1 for c in cells), default=0), max((c.col + 1 for c in cells), default=0)
    rows = [[""] * width for _ in range(height)]
    for c in cells:
        for y in range(c.row, min(c.row + max(c.row_span, 1), height)):
            rows[y][c.col:c.col + max(c.col_span, 1)] = [c.text] * min(max(c.col_span, 1), width - c.col)
    return rows
