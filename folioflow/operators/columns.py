"""Reading order of pages with columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A gutter's least width in points, in shares of the region and in median fonts; the font of lines that state none.
GUTTER, GUTTER_SHARE, GUTTER_FONTS, FONT = 18.0, 0.04, 1.5, 10.0
#: A column's least lines, and its width in points and in shares of the region; how far columns must stand beside each other.
LINES, WIDTH, WIDTH_SHARE, BESIDE = 2, 36.0, 0.12, 0.2
#: Distance of lines that make a pair, in median fonts and in shares of the lower column; share of a column that a line over both may leave out.
PAIR_FONTS, PAIR_SHARE, LEFT_OUT = 4.0, 0.12, 0.25
#: Fixed value: how often a region may be cut.
DEPTH = 8

#: Columns of a page's array: left, right, low and high edge, font.
_L, _R, _LOW, _HIGH, _FONT = range(5)


def _middles(lines: np.ndarray) -> np.ndarray:
    return (lines[:, _LOW] + lines[:, _HIGH]) / 2


def _pairs(one: np.ndarray, other: np.ndarray, within: float) -> int:
    """How many lines of two columns can be paired, each once, from the top down."""
    ys, zs, n = list(np.sort(_middles(one))), list(np.sort(_middles(other))), 0
    while ys and zs:
        apart = ys[-1] - zs[-1]
        n += abs(apart) <= within
        if apart >= -within:
            ys.pop()
        if apart <= within:
            zs.pop()
    return n


def _score(p: np.ndarray, at: float, width: float, gutter: float, font: float) -> float:
    """How good a cut at this place is; 0 for none."""
    on_left, on_right = p[:, _R] <= at, p[:, _L] >= at
    a, b, over = p[on_left], p[on_right], p[~on_left & ~on_right]
    if min(len(a), len(b)) < LINES:
        return 0.0
    (l0, r0), (l1, r1) = ((c[:, _L].min(), c[:, _R].max()) for c in (a, b))
    (low0, high0), (low1, high1) = ((c[:, _LOW].min(), c[:, _HIGH].max()) for c in (a, b))
    shorter, beside = min(high0 - low0, high1 - low1), min(high0, high1) - max(low0, low1)
    if l1 - r0 < gutter or min(r0 - l0, r1 - l1) < max(WIDTH, WIDTH_SHARE * width) or min(beside, shorter) <= 0 or beside < BESIDE * shorter:
        return 0.0
    if _pairs(a, b, max(PAIR_FONTS * font, PAIR_SHARE * shorter)) < LINES:
        return 0.0
    if np.any((over[:, _L] > l0 + LEFT_OUT * (r0 - l0)) | (over[:, _R] < r1 - LEFT_OUT * (r1 - l1))):
        return 0.0
    return (l1 - r0) * (0.5 + 0.5 * min(len(a), len(b)) / max(len(a), len(b))) * (0.5 + 0.5 * min(1.0, beside / shorter))


def _cut(p: np.ndarray) -> float | None:
    """The middle of the best gutter, the leftmost of equals."""
    width = p[:, _R].max() - p[:, _L].min()
    stated = p[p[:, _FONT] > 0, _FONT]
    font = float(np.median(stated)) if len(stated) else FONT
    gutter = max(GUTTER, GUTTER_SHARE * width, GUTTER_FONTS * font)
    edges = np.sort(p[:, [_L, _R]], axis=None)
    places = ((edges[1:] + edges[:-1]) / 2)[np.diff(edges) >= gutter]
    scores = [_score(p, at, width, gutter, font) for at in places]
    return float(places[int(np.argmax(scores))]) if scores and max(scores) > 0 else None


def column_order(p: np.ndarray) -> np.ndarray:
    """The reading order of a page's lines (left, right, low, high, font): row numbers of p.

    The best gutter cuts a region into columns, each read from the top down and cut again. Lines over both columns
    cut it into bands first. Regions without a gutter, and pages with a line without width, stay in the order given.
    """
    if len(p) < 2 * LINES or np.isnan(p[:, :_FONT]).any() or (p[:, _R] <= p[:, _L]).any():
        return np.arange(len(p))
    out: list[np.ndarray] = []
    todo = [(np.arange(len(p)), 0)]  # regions still to read, the next one last
    while todo:
        rows, depth = todo.pop()
        region = p[rows]
        at = _cut(region) if len(rows) >= 2 * LINES and depth < DEPTH else None
        if at is None:
            out.append(rows)
            continue
        down = np.lexsort((region[:, _L], -region[:, _HIGH]))
        rows, region = rows[down], region[down]
        on_left, on_right = region[:, _R] <= at, region[:, _L] >= at
        over = ~on_left & ~on_right
        # a line belongs to the band over the first line across whose middle it is above
        heights = np.minimum.accumulate(_middles(region[over]))
        band = np.searchsorted(-heights, -_middles(region), side="right")
        parts = []
        for k in range(len(heights) + 1):
            parts += [(rows[on_left & (band == k)], depth + 1), (rows[on_right & (band == k)], depth + 1)]
            if k < len(heights):
                parts.append((rows[over][k:k + 1], DEPTH))
        todo += reversed([part for part in parts if len(part[0])])
    return np.concatenate(out)


def by_columns(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines (*by, ord, min_x, max_x, min_y, max_y, font, ...) with place: their reading order on a page, columns one after the other.

    A task holds the places of one page at a time. Null places count as missing: such a page stays in the order of ord.
    """
    slim = lines.select(*by, *(F.col(c).cast(t).alias(c) for c, t in (("ord", "long"), *((c, "double") for c in ("min_x", "max_x", "min_y", "max_y", "font")))))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ord")
        p = np.column_stack([table[c].fill_null(float("nan") if c != "font" else 0.0).to_numpy() for c in ("min_x", "max_x", "min_y", "max_y", "font")])
        place = np.empty(len(p), np.int64)
        place[column_order(p)] = np.arange(len(p))
        return table.select([*by, "ord"]).append_column("place", pa.array(place))

    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    places = slim.groupBy(*by).applyInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "ord long", "place long"]))
    return lines.join(places.hint("merge"), [*by, "ord"])  # as many rows as lines, whatever a guess says
