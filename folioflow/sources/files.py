"""Files of any format read: one reader by extension, archives of pages, heads of raster images."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import data_uri, mime_type
from folioflow.operators.document import to_markdown
from folioflow.sources import asciidoc, csv_tables, drawings, html_pages, json_documents, legacy, mail, markdown, office_files, pdf, vector_files
from folioflow.sources.elements import _TYPES, SCHEMA, Element, batched, gfm

#: An archive's pages together, unpacked; a longer one is an error of that file.
MAX_ARCHIVE = 64 << 20


def plain(text: str) -> list[Element]:
    text = text.removeprefix("﻿").strip()
    return [Element("text", text)] if text else []


def table(text: str) -> list[Element]:
    rows = csv_tables.parse(text)
    return [Element("table", gfm(rows))] if rows else []


def book(data: bytes) -> list[Element]:
    """The pages of an e-book in the order of its spine."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = next(e.attrib["full-path"] for e in root.iter() if e.tag.endswith("}rootfile"))
        opf = ElementTree.fromstring(z.read(package))
        items = {e.attrib["id"]: e.attrib["href"] for e in opf.iter() if e.tag.endswith("}item")}
        paths = [posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(items[e.attrib["idref"]]))) for e in opf.iter() if e.tag.endswith("}itemref") and e.attrib["idref"] in items]
        if sum(z.getinfo(p).file_size for p in paths) > MAX_ARCHIVE:
            raise ValueError("archive too large")
        pages = [html_pages.parse(z.read(p).decode("utf-8", "replace")) for p in paths]
    return [e for page in pages for e in page if e.layer == "body"]


def image(data: bytes) -> list[Element]:
    return [Element("picture", "")] if raster_size(data) else []


def raster_size(data: bytes) -> tuple[int, int] | None:
    """(width, height) in pixels by a PNG, BMP, WebP or JPEG file's head; None for other files."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def _text(parse: Callable[[str], list[Element]]) -> Callable[[bytes], list[Element]]:
    return lambda data: parse(data.decode("utf-8", "replace"))


READERS: dict[str, Callable[[bytes], list[Element]]] = {
    ".txt": _text(plain), ".md": _text(markdown.parse), ".markdown": _text(markdown.parse), ".html": _text(html_pages.parse), ".htm": _text(html_pages.parse), ".adoc": _text(asciidoc.parse),
    ".asciidoc": _text(asciidoc.parse), ".csv": _text(table), ".eml": _text(mail.parse), ".epub": book, ".png": image, ".jpg": image, ".jpeg": image, ".bmp": image, ".webp": image,
    ".xlsx": office_files.workbook, ".docx": office_files.document, ".pptx": office_files.slides,
    ".json": _text(json_documents.parse), ".svg": vector_files.vector_image, ".glb": vector_files.model_file,
    ".doc": legacy.document, ".xls": legacy.workbook, ".dxf": drawings.drawing, ".dwg": drawings.drawing,
}


def _rows(doc: dict) -> list[tuple]:
    path = doc["path"] or ""
    reader = READERS.get(posixpath.splitext(path)[1].lower())
    if reader is None:
        return [(doc["doc_id"], *[None] * 8, path, "unknown format")]
    try:
        return [(doc["doc_id"], k, e.label, e.level, e.depth, e.layer, e.text, e.marker, e.language, path, None) for k, e in enumerate(reader(doc["content"] or b""))]
    except (ValueError, LookupError, AttributeError, struct.error, StopIteration, RecursionError, zipfile.BadZipFile, zlib.error, ElementTree.ParseError) as e:
        return [(doc["doc_id"], *[None] * 8, path, f"{type(e).__name__}: {e}")]


def read_once(files: DataFrame) -> DataFrame:
    """(SCHEMA, path, error) of files as for read, from one reading: elements, and for each file that is a fault a row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((row for batch in batches for doc in batch.to_pylist() for row in _rows(doc)), names, (*_TYPES, pa.string(), pa.string()))

    schema = SCHEMA + ", path string, error string"
    names = [f.split()[0] for f in schema.split(", ")]
    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)


def read(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements, faults) of files (doc_id, path, content), as spark.read.format("binaryFile") gives path and content.

    The extension, in either case, picks the reader. faults (doc_id, path, error) has the files of unknown formats and
    those that their reader refuses: one bad file doesn't stop the others. A null content is an empty file.
    Whoever needs both frames reads the files twice; read_once does not.
    """
    out = read_once(files)
    return out.where("error is null").drop("path", "error"), out.where("error is not null").select("doc_id", "path", "error")


def read_all(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """read, and PDF files by their own reader, which runs a job at once."""
    is_pdf = F.coalesce(F.lower("path").endswith(".pdf"), F.lit(False))
    elements, faults = read(files.where(~is_pdf))
    return elements.unionByName(pdf.read(files.where(is_pdf).select(F.col("doc_id").cast("long").alias("doc_id"), "content"))), faults


def markdown_of(files: DataFrame) -> DataFrame:
    """(doc_id, markdown) of files: read and exported."""
    return to_markdown(read(files)[0])


def image_uris(files: DataFrame) -> DataFrame:
    """(doc_id, uri) of image files (doc_id, path, content)."""
    return files.select("doc_id", data_uri(F.col("content"), mime_type(F.col("path"))).alias("uri"))


def png_size(data: Column) -> Column:
    """(width, height) of a PNG file by its head alone, null for other files: no Python worker is needed where only these count."""
    number = lambda at: F.conv(F.hex(F.substr(data, F.lit(at), F.lit(4))), 16, 10).cast("long")
    return F.when(F.hex(F.substr(data, F.lit(1), F.lit(8))) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))
