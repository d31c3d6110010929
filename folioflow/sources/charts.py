"""Charts of Office files: their kind, title and points as a table."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources.elements import Element, gfm

#: Chart kinds by their elements, and the words of tables' heads.
CLASSES = {
    "areaChart": "area_chart", "area3DChart": "area_chart", "barChart": "bar_chart", "bar3DChart": "bar_chart", "bubbleChart": "bubble_chart", "doughnutChart": "doughnut_chart",
    "lineChart": "line_chart", "line3DChart": "line_chart", "ofPieChart": "pie_chart", "pieChart": "pie_chart", "pie3DChart": "pie_chart", "radarChart": "radar_chart",
    "scatterChart": "scatter_chart", "stockChart": "stock_chart", "surfaceChart": "surface_chart", "surface3DChart": "surface_chart",
}
CATEGORY, ACROSS, SERIES, ITS_X, ITS_SIZE = "类别", "X", "系列 ", "·X", "·气泡大小"
MIXED = "combo_chart"
#: Cells of a chart's table; points may name any index.
MAX_CELLS = 100_000


def _local(node) -> str:
    return node.tag.rpartition("}")[2]


def _child(node, *names: str):
    return next((c for c in node if _local(c) in names), None) if node is not None else None


def _points(node) -> dict[int, str]:
    """Values by index, the first of equal ones; several levels of categories give the innermost."""
    out: dict[int, str] = {}
    for pt in (p for p in node.iter() if _local(p) == "pt") if node is not None else ():
        v = _child(pt, "v")
        out.setdefault(int(pt.get("idx", "0")), (v.text or "") if v is not None else "")
    return out


def _words(node) -> str:
    return "".join(t.text for t in node.iter() if _local(t) in ("t", "v") and t.text and t.text.strip()).strip() if node is not None else ""


def parse(data: bytes) -> tuple[str, str, list[list[str]]] | None:
    """(kind, title, rows) of a chart part; None without a chart of a known kind.

    Column one holds categories, or X if the first series has numbers on both axes. Later such series have a column of
    their own for X, bubbles one for their size. Indices without a point are empty cells.
    """
    root = ElementTree.fromstring(data)
    plots = [(CLASSES[_local(n)], n) for n in root.iter() if _local(n) in CLASSES]
    if not plots:
        return None
    series = [(kind, s) for kind, plot in plots for s in plot.iter() if _local(s) == "ser"]
    both_axes = [kind in ("scatter_chart", "bubble_chart") for kind, _ in series]
    axis: dict[int, str] = {}
    columns: list[tuple[str, dict[int, str]]] = []
    for k, (kind, s) in enumerate(series):
        name = _words(_child(s, "tx")) or f"{SERIES}{k + 1}"
        across = _points(_child(s, "xVal" if both_axes[k] else "cat"))
        for idx, value in across.items():
            axis.setdefault(idx, value)
        if both_axes[k] and not both_axes[0]:
            columns.append((name + ITS_X, across))
        columns.append((name, _points(_child(s, "yVal" if both_axes[k] else "val"))))
        if kind == "bubble_chart":
            columns.append((name + ITS_SIZE, _points(_child(s, "bubbleSize"))))
    last = max((idx for at in (axis, *(c for _, c in columns)) for idx in at), default=-1)
    if (last + 2) * (len(columns) + 1) > MAX_CELLS:
        raise ValueError("chart has too many cells")
    head = [[ACROSS if both_axes[0] else CATEGORY, *(name for name, _ in columns)]] if series else []
    kinds = {kind for kind, _ in plots}
    title = next((n for n in root.iter() if _local(n) == "title"), None)
    return MIXED if len(kinds) > 1 else plots[0][0], _words(title), head + [[axis.get(i, ""), *(at.get(i, "") for _, at in columns)] for i in range(last + 1 if series else 0)]


def elements(data: bytes) -> list[Element]:
    """A chart as its title and its table."""
    found = parse(data)
    if found is None:
        return []
    return [Element("caption", found[1])] * bool(found[1]) + [Element("table", gfm(found[2]))] * bool(found[2])


def charts(parts: DataFrame) -> DataFrame:
    """(doc_id, kind, title, rows) of chart parts (doc_id, content). Nulls, broken parts and parts without a chart give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc_id, content in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                    try:
                        found = parse(content) if content else None
                    except (ElementTree.ParseError, ValueError):
                        found = None
                    out += [(doc_id, *found)] if found else []
                types = pa.int64(), pa.string(), pa.string(), pa.list_(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["doc_id", "kind", "title", "rows"])

    return parts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "doc_id long, kind string, title string, rows array<array<string>>")
