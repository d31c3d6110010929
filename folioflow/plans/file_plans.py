"""Queries over files that are made here from customers: a PDF page each, and an Office file of one of three formats."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators.tables import spread
from folioflow.sources import files, pdf


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pdfs(spark, sf_dir):
    """A page with a name in a large font and three lines of text, and a number at its foot that the second page has too."""
    page = lambda body: F.concat(F.lit("<<>>stream\nBT /F1 10 Tf 50 40 Td (Report) Tj ET BT "), body, F.lit(" ET\nendstream endobj\n"))
    first = F.concat(F.lit("/F1 18 Tf 50 750 Td ("), "c_name", F.lit(") Tj /F1 10 Tf 0 -20 Td (Segment "), "c_mktsegment", F.lit(") Tj 14 TL T* [(Ke) 20 (y "), F.col("c_custkey").cast("string"), F.lit(")] TJ T* <456e64> Tj"))
    head = "%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj\n2 0 obj<</Type/Pages/Kids[3 0 R 6 0 R 8 0 R]/MediaBox[0 0 600 800]/Resources<</Font<</F1 5 0 R>>>>>>endobj\n3 0 obj<</Type/Page/Parent 2 0 R/Contents 4 0 R>>endobj\n6 0 obj<</Type/Page/Contents[7 0 R]>>endobj\n8 0 obj<</Type/Page/Contents 9 0 R>>endobj\n5 0 obj<</Type/Font/Subtype/Type1/Encoding/WinAnsiEncoding>>endobj\n"
    body = F.concat(F.lit(head + "4 0 obj"), page(first), F.lit("7 0 obj"), page(F.lit("/F1 10 Tf 50 700 Td (second \\(page\\)) Tj")), F.lit("9 0 obj"), page(F.lit("/F1 10 Tf 50 600 Td (third) Tj 60 1 Td (x) Tj")))
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return c.select(F.col("c_custkey").alias("doc_id"), F.encode(body, "utf-8").alias("content"))


def pdf_elements(spark, sf_dir):
    return pdf.read(_pdfs(spark, sf_dir)).select("doc_id", "ord", "label", "layer", "text")


def pdf_lines(spark, sf_dir):
    return pdf.lines(_pdfs(spark, sf_dir)).select("doc_id", "page_no", "ord", "text", "font")


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def _office(key: int, name: str, segment: str) -> bytes:
    name, segment = escape(name), escape(segment)
    rels = lambda kind, target: f'<Relationships><Relationship Id="r" Type="t/{kind}" Target="{target}"/></Relationships>'
    if key % 3 == 0:
        cells = "".join(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>' for at, v in (("B2", "name"), ("C2", "segment"), ("B3", name), ("C3", segment)))
        return _archive({"xl/workbook.xml": '<workbook><sheets><sheet name="Sheet" id="r"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": rels("worksheet", "s.xml"), "xl/s.xml": f"<worksheet><sheetData>{cells}</sheetData></worksheet>"})
    if key % 3 == 1:
        p = lambda text, style: f'<p><pPr><pStyle val="{style}"/></pPr><r><t>{text}</t></r></p>'
        return _archive({"word/document.xml": f"<document><body>{p(name, 'Heading2')}{p(segment, '')}</body></document>"})
    sp = lambda y, text, kind: f'<sp><nvSpPr><nvPr><ph type="{kind}"/></nvPr></nvSpPr><spPr><xfrm><off x="0" y="{y}"/></xfrm></spPr><txBody><p><r><t>{text}</t></r></p></txBody></sp>'
    return _archive({"ppt/presentation.xml": '<p xmlns:r="x"><sldIdLst><sldId r:id="r"/></sldIdLst></p>', "ppt/_rels/presentation.xml.rels": rels("slide", "s.xml"), "ppt/s.xml": f"<sld><cSld><spTree>{sp(900_000, segment, 'body')}{sp(0, name, 'title')}</spTree></cSld></sld>"})


def _made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f"f{k}{('.xlsx', '.DOCX', '.pptx')[k % 3]}" for k, *_ in rows]), pa.array([_office(*r) for r in rows], pa.binary())], names=["doc_id", "path", "content"])


def office_elements(spark, sf_dir):
    made = spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey").mapInArrow(_made, "doc_id long, path string, content binary")
    return files.read(made)[0].select("doc_id", "ord", "label", F.col("level").cast("long").alias("level"), "text")


QUERIES = {f.__name__: f for f in (pdf_elements, pdf_lines, office_elements)}

SQL = {
    "pdf_elements": """SELECT c_custkey AS doc_id, CAST(u.e.ord AS BIGINT) AS ord, u.e.label AS label, CASE WHEN u.e.label = 'page_footer' THEN 'furniture' ELSE 'body' END AS layer, u.e.t AS text
FROM customer, unnest([{'ord': 0, 'label': 'title', 't': c_name}, {'ord': 1, 'label': 'text', 't': 'Segment ' || c_mktsegment || chr(10) || 'Key ' || c_custkey || chr(10) || 'End'}, {'ord': 2, 'label': 'page_footer', 't': 'Report'}, {'ord': 3, 'label': 'text', 't': 'second (page)'}, {'ord': 4, 'label': 'page_footer', 't': 'Report'}, {'ord': 5, 'label': 'text', 't': 'third x'}, {'ord': 6, 'label': 'page_footer', 't': 'Report'}]) AS u(e)""",
    "pdf_lines": """SELECT c_custkey AS doc_id, CAST(u.e.p AS BIGINT) AS page_no, CAST(u.e.ord AS BIGINT) AS ord, u.e.t AS text, CASE WHEN u.e.ord = 0 THEN CAST(18 AS DOUBLE) ELSE 10 END AS font
FROM customer, unnest([{'p': 0, 'ord': 0, 't': c_name}, {'p': 0, 'ord': 1, 't': 'Segment ' || c_mktsegment}, {'p': 0, 'ord': 2, 't': 'Key ' || c_custkey}, {'p': 0, 'ord': 3, 't': 'End'}, {'p': 0, 'ord': 4, 't': 'Report'}, {'p': 1, 'ord': 5, 't': 'second (page)'}, {'p': 1, 'ord': 6, 't': 'Report'}, {'p': 2, 'ord': 7, 't': 'third x'}, {'p': 2, 'ord': 8, 't': 'Report'}]) AS u(e)""",
    "office_elements": """SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS ord, ['section_header', 'section_header', 'title'][c_custkey % 3 + 1] AS label, [1, 2, 0][c_custkey % 3 + 1]::BIGINT AS level, CASE WHEN c_custkey % 3 = 0 THEN 'Sheet' ELSE c_name END AS text FROM customer
UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 3 = 0 THEN 'table' ELSE 'text' END, 0, CASE WHEN c_custkey % 3 = 0 THEN '| name | segment |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || c_mktsegment || ' |' ELSE c_mktsegment END FROM customer""",
}
