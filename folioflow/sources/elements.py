"""What all markup readers return: the elements of documents in reading order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, ord long, label string, level int, depth int, layer string, text string, marker string, language string"
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string())


class Element(NamedTuple):
    """label: title, section_header, text, list_item, code, table, picture or caption. level: of headings. depth: of nested lists."""

    label: str
    text: str
    level: int = 0
    depth: int = 0
    layer: str = "body"
    marker: str = ""
    language: str = ""


def heading(rank: int, text: str) -> Element:
    """The first rank is the title; the others are section headers one level up."""
    return Element("title", text) if rank == 1 else Element("section_header", text, level=rank - 1)


def gfm(rows: list[list[str]]) -> str:
    """Rows as pipe lines of equal width, the first as header."""
    width = max(map(len, rows), default=0)
    lines = ["| " + " | ".join(c.strip().replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([*lines[:1], "| " + " | ".join(["---"] * width) + " |", *lines[1:]]) if lines and width else ""


#: Rows and characters of the batches that a reader returns.
BATCH_ROWS, BATCH_CHARS = 4096, 4 << 20


def batched(rows: Iterable[tuple], names: list[str], types: Sequence[pa.DataType], text_at: int = 6) -> Iterator[pa.RecordBatch]:
    """Rows, with their text at that place, in batches of bounded size, however many a document has."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[text_at] or "")
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def read(docs: DataFrame, parse: Callable[[str], list[Element]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Elements (SCHEMA) of each row of docs; a null or empty text has none. Rows are parsed one by one, so memory is bounded by the longest text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs_ = ((i, t) for batch in batches for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows = ((i, k, e.label, e.level, e.depth, e.layer, e.text, e.marker, e.language) for i, t in docs_ for k, e in enumerate(parse(t or "")))
        return batched(rows, [f.split()[0] for f in SCHEMA.split(", ")], _TYPES)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)
