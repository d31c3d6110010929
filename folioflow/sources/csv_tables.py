"""CSV documents as cells."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Delimiters in the order in which they are tried.
DELIMITERS = ",;\t|:"
CELLS = "doc_id long, row long, col long, text string, column_header boolean"


def parse(text: str | None) -> list[list[str]]:
    """Rows of equal width: by the delimiter that splits all rows alike into the most columns, else by commas."""
    text = (text or "").removeprefix("﻿")
    best: list[list[str]] | None = None
    for d in DELIMITERS:
        rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=d) if r]
        if rows and len({len(r) for r in rows}) == 1 and len(rows[0]) > (len(best[0]) if best else 1):
            best = rows
    rows = best or [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(d, i, j, c, i == 0) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, r in enumerate(parse(t)) for j, c in enumerate(r)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "row", "col", "text", "column_header"])


def cells(docs: DataFrame) -> DataFrame:
    """Cells of documents (doc_id, text): the first row is the header, an empty document has none."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_cells, CELLS)
