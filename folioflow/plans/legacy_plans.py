"""Queries over older Office files, drawings and charts made from customers, answers of a recogniser, and places of grids."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import office
from folioflow.operators import pages, recognise
from folioflow.operators.tables import spread, tasks
from folioflow.plans import made_files
from folioflow.plans.file_plans import _archive
from folioflow.sources import charts, files


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _made(spark, sf_dir, make: Callable[[int, str, str], tuple[str, bytes]]) -> DataFrame:
    """(doc_id, path, content): a file of each customer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                found = [make(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p for p, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["doc_id", "path", "content"])

    rows = spread(_t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment"), "c_custkey")
    return rows.mapInArrow(run, "doc_id long, path string, content binary")


def _legacy(key: int, name: str, segment: str) -> tuple[str, bytes]:
    if key % 2:
        return f"{key}.XLS", made_files.old_workbook(name, segment, key)
    return f"{key}.doc", made_files.old_document([f"{name}\r", f"\x13 PAGE \x14{key}\x15\r\r", f"{segment} 客户\r", "cell\x07\r"])


def legacy_elements(spark, sf_dir):
    """Workbooks and Word documents of the older formats, every other customer."""
    return files.read(_made(spark, sf_dir, _legacy))[0].select("doc_id", "ord", "label", F.col("level").cast("long").alias("level"), "text")


def drawing_texts(spark, sf_dir):
    """Drawings with a formatted text, and a block that is inserted twice."""
    made = _made(spark, sf_dir, lambda key, name, segment: (f"{key}.dxf", made_files.drawing(name, segment, key)))
    return files.read(made)[0].select("doc_id", "ord", "label", "text")


def chart_parts(spark, sf_dir):
    """Charts with gaps, with series without a name, and with bubbles beside bars for every other customer."""
    found = charts.charts(_made(spark, sf_dir, lambda key, name, _: ("", made_files.chart(name, key))))
    return found.select("doc_id", "kind", "title", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("table"))


def _recogniser(page: dict) -> str:
    key, name = page["page_no"], page["name"]
    if key % 5 == 0:
        raise TimeoutError
    if key % 5 == 1:
        return f"```md\n{name}\n```"
    if key % 5 == 2:
        return f"again {page['feedback']}" if page["attempt"] == 2 else " "
    return "Here is the OCR result: " + name if key % 5 == 3 else "I'm sorry"


def recognised_pages(spark, sf_dir):
    """A recogniser that answers, answers at the second time, refuses or fails; every third page has a clean text already."""
    existing = F.when(F.col("c_custkey") % 3 == 0, F.lit("known")).when(F.col("c_custkey") % 3 == 1, F.lit("��"))
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey")
    p = c.select(F.lit(1).cast("long").alias("doc_id"), F.col("c_custkey").cast("long").alias("page_no"), F.col("c_name").alias("name"), existing.alias("existing"))
    return recognise.recognised(p, _recogniser).select("page_no", "text", F.col("attempt").cast("long").alias("attempt"), "fault")


def grid_places(spark, sf_dir):
    """Tables of orders: each line's cell spans two rows and begins in the column of its number, some beyond the table."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("t"), F.col("l_linenumber").cast("long").alias("n"))
    k = tasks(lines)
    lines = lines.repartition(k, "t").distinct()
    cells = lines.select("t", F.col("n").alias("idx"), (F.col("n") - 1).alias("r0"), (F.col("n") + 1).alias("r1"), (F.col("n") % 2).alias("c0"), (F.col("n") % 2 + 1 + F.col("n") % 3).alias("c1"), F.col("n").cast("string").alias("text"))
    sizes = lines.groupBy("t").agg(F.max("n").alias("rows")).withColumn("cols", F.lit(3).cast("long"))
    return pages.grid_places(cells, sizes, ["t"], 2 * k).withColumn("idx", F.coalesce("idx", F.lit(-1)))


def _visual(page: dict) -> str:
    key = page["page"]
    item = {"label": "text", "text": f"{page['name']} {page['feedback'] or ''}".strip(), "level": 1, "confidence": 0.75, "l": 1.0, "t": 20.0, "r": 30.0, "b": 10.0}
    if key % 4 == 1 and page["attempt"] == 1:
        return "[{"
    if key % 4 == 2:
        item["confidence"] = 0.25 if page["attempt"] == 1 or key % 8 == 2 else 0.5
    table = {"label": "table", "confidence": 1, "l": 1, "t": 60, "r": 30, "b": 30, "rows": 1, "cols": 1, "turn": 0, "cells": [{"r0": 0, "r1": 1, "c0": 0, "c1": 1, "text": str(key)}]}
    return json.dumps([item, table])


def visual_results(spark, sf_dir):
    """A visual model that answers, or answers well at the second time, or never; pages it fails on have one row with the fault."""
    p = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("page"), F.lit(600.0).alias("width"), F.lit(800.0).alias("height"), F.col("c_name").alias("name"))
    items, faults = recognise.visual_items(p, _visual)
    said = items.select("page", F.col("ord").cast("long").alias("ord"), "label", F.coalesce("text", F.element_at("cells", 1)["text"]).alias("text"))
    return said.unionByName(faults.select("page", F.lit(-1).cast("long").alias("ord"), F.lit("fault").alias("label"), F.col("attempt").cast("string").alias("text")))


def _omml(key: int, name: str, segment: str) -> tuple[str, bytes]:
    run = lambda text: f"<m:r><m:t>{escape(text)}</m:t></m:r>"
    part = lambda tag, *inner: f"<m:{tag}>{''.join(inner)}</m:{tag}>"
    fraction = part("f", part("num", run(str(key))), part("den", part("rad", part("deg"), part("e", run("α%")))))
    total = part("nary", '<m:naryPr><m:chr m:val="∑"/></m:naryPr>', part("sub", run("i")), part("sup"), part("e", part("sSup", part("e", run("x")), part("sup", run("2")))))
    box = f"<r><AlternateContent><Choice><txbxContent><p><r><t>{escape(segment)}</t></r></p></txbxContent></Choice><Fallback><txbxContent><p><r><t>{escape(segment)}</t></r></p></txbxContent></Fallback></AlternateContent></r>"
    body = f"<p><m:oMathPara><m:oMath>{fraction}{total}</m:oMath></m:oMathPara></p><p><r><t>{escape(name)}: </t></r><m:oMath>{part('d', part('e', run('a')), part('e', run('b')))}</m:oMath>{box}</p>"
    return f"{key}.docx", _archive({"word/document.xml": f'<document xmlns:m="m"><body>{body}</body></document>'})


def word_formulas(spark, sf_dir):
    """Word files with a formula of its own, one inside a line, and a text box in two versions."""
    return files.read(_made(spark, sf_dir, _omml))[0].select("doc_id", "ord", "label", "text")


def picture_meta(spark, sf_dir):
    """What is known of pictures, over what others say of them: equal names, blank and null values."""
    j = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    extra = F.create_map(F.lit("own:name"), j(F.col("c_name")), F.lit("code"), F.lit('"old"'), F.lit('a"b'), F.lit("[1, 2]"))
    known = F.create_map(F.lit("code"), F.when(F.col("c_custkey") % 3 == 0, j(F.col("c_mktsegment"))).when(F.col("c_custkey") % 3 == 1, " null "), F.lit("description"), F.when(F.col("c_custkey") % 2 == 0, '{"text":""}'))
    return _t(spark, sf_dir, "customer").select("c_custkey", office.merged_meta(extra, known).alias("meta"))


QUERIES = {f.__name__: f for f in (legacy_elements, drawing_texts, chart_parts, recognised_pages, grid_places, visual_results, word_formulas, picture_meta)}

SQL = {
    "legacy_elements": """WITH c AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS s FROM customer)
SELECT k AS doc_id, CAST(0 AS BIGINT) AS ord, 'section_header' AS label, CAST(1 AS BIGINT) AS level, 'Sheet' AS text FROM c WHERE k % 2 = 1
UNION ALL SELECT k, 1, 'table', 0, concat('| name | segment |  |', chr(10), '| --- | --- | --- |', chr(10), '| ', n, ' | ', s, ' |  |', chr(10), '| ', k, ' | ', k, ' | ', k, '% |') FROM c WHERE k % 2 = 1
UNION ALL SELECT k, i, 'text', 0, [n, k::VARCHAR, s || ' 客户', 'cell'][i + 1] FROM c, range(4) AS r(i) WHERE k % 2 = 0""",
    "drawing_texts": """SELECT c_custkey AS doc_id, i AS ord, CASE WHEN i = 0 THEN 'section_header' ELSE 'text' END AS label, ['整图', c_name || chr(10) || c_mktsegment, c_custkey || '°', c_name, c_custkey || '°'][i + 1] AS text FROM customer, range(5) AS r(i)""",
    "chart_parts": """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 1 THEN 'combo_chart' ELSE 'bar_chart' END AS kind, 'Chart ' || c_name AS title,
concat('类别|', c_name, '|系列 2', CASE WHEN c_custkey % 2 = 1 THEN '|系列 3·X|系列 3|系列 3·气泡大小' ELSE '' END, '/a|', c_custkey, '|', CASE WHEN c_custkey % 2 = 1 THEN '|7|8|9' ELSE '' END,
'/||', c_custkey * 2, CASE WHEN c_custkey % 2 = 1 THEN '|||' ELSE '' END, '/c|', c_custkey + 2, '|', CASE WHEN c_custkey % 2 = 1 THEN '|||' ELSE '' END) AS "table" FROM customer""",
    "recognised_pages": """WITH f AS (SELECT c_custkey AS page_no, c_custkey % 5 AS k, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 5 IN (1, 2, 3) THEN 'worse' WHEN c_custkey % 5 = 0 THEN 'failed' WHEN c_custkey % 5 = 4 THEN 'refused' END AS fault, c_name FROM customer)
SELECT page_no, CASE WHEN fault IS NULL THEN CASE WHEN k = 2 THEN 'again empty' ELSE c_name END END AS text, CAST(CASE WHEN k IN (1, 3) THEN 1 ELSE 2 END AS BIGINT) AS attempt, fault FROM f""",
    "grid_places": """WITH l AS (SELECT DISTINCT l_orderkey AS t, CAST(l_linenumber AS BIGINT) AS n FROM lineitem), s AS (SELECT t, max(n) AS m FROM l GROUP BY t),
p AS (SELECT t, r.i AS r, c.i AS c FROM s, range(7) AS r(i), range(3) AS c(i) WHERE r.i < m)
SELECT p.t, p.r, p.c, coalesce(max(n), -1) AS idx, CASE WHEN max(n) IS NULL THEN 1 ELSE CAST(2 AS BIGINT) END AS row_span, CAST(coalesce(max(n) % 3 + 1, 1) AS BIGINT) AS col_span, coalesce(max(n)::VARCHAR, '') AS text
FROM p LEFT JOIN l ON l.t = p.t AND p.r BETWEEN n - 1 AND n AND p.c >= n % 2 AND p.c < n % 2 + 1 + n % 3 GROUP BY p.t, p.r, p.c""",
    "visual_results": """WITH c AS (SELECT c_custkey AS page, c_name AS n, c_custkey % 8 = 2 AS bad, CASE WHEN c_custkey % 4 = 1 THEN ' no JSON' WHEN c_custkey % 4 = 2 THEN ' confidence' ELSE '' END AS f FROM customer)
SELECT page, CAST(0 AS BIGINT) AS ord, 'text' AS label, n || f AS text FROM c WHERE NOT bad UNION ALL SELECT page, 1, 'table', page::VARCHAR FROM c WHERE NOT bad UNION ALL SELECT page, -1, 'fault', '2' FROM c WHERE bad""",
    "word_formulas": r"""SELECT c_custkey AS doc_id, i AS ord, ['formula', 'text', 'text'][i + 1] AS label, ['\frac{' || c_custkey || '}{\sqrt{\alpha \%}}\sum_{i}{{x}^{2}}', c_name || ': \left(a|b\right)', c_mktsegment][i + 1] AS text FROM customer, range(3) AS r(i)""",
    "picture_meta": r"""SELECT c_custkey, concat('{"a\"b":[1, 2],"code":', CASE WHEN c_custkey % 3 = 0 THEN '"' || c_mktsegment || '"' ELSE '"old"' END, CASE WHEN c_custkey % 2 = 0 THEN ',"description":{"text":""}' ELSE '' END, ',"own:name":"', c_name, '"}') AS meta FROM customer""",
}
