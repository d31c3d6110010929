"""Queries over tables of pages, vector images and model files that are made here from customers."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import tree_json
from folioflow.operators.tables import LEAST_LINES, MOST_LINES, spread
from folioflow.sources import files, html_tables, json_documents
from folioflow.sources import elements as rows
from folioflow.sources.vector_files import GLB_BINARY, GLB_JSON, GLB_MARK


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _customers(spark, sf_dir):
    """Customers in as many tasks as the files made of them ask for."""
    return spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey"), "c_custkey")


def _with_faults(found, text, *more):
    """Elements with that text, and files' faults as rows of their own."""
    bad = F.col("error").isNotNull()
    return found.select("doc_id", F.when(bad, -1).otherwise(F.col("ord")).cast("long").alias("ord"), F.when(bad, "fault").otherwise(F.col("label")).alias("label"), *(F.when(bad, 0).otherwise(F.col(c)).cast("long").alias(c) for c in more), F.when(bad, F.col("error")).otherwise(text).alias("text"))


def _text(*parts):
    return F.concat(*(F.col(p[1:]).cast("string") if p.startswith("$") else F.lit(p) for p in parts))


def html_cells(spark, sf_dir):
    """A head over two columns, a row header over two rows, a table in a cell, and a foot."""
    page = _text(
        "<h1>x</h1><table><thead><tr><th>key<th colspan=2>who</tr></thead><tr><th rowspan=2>", "$c_custkey", "<td>", "$c_name", "<br>&amp;<td hidden>", "$c_mktsegment",
        "<tr><td colspan='2 columns'><table><tr><td>", "$c_nationkey", "</table></td></tr><tfoot><tr><td>sum</tfoot></table><table></table>",
    )
    out = html_tables.cells(_customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), page.alias("html")))
    return out.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("table_no", "row", "col", "row_span", "col_span")), "column_header", "row_header", "text")


def vector_elements(spark, sf_dir):
    """Images with a title, texts in groups and parts that must go; every seventh has another root and is a fault."""
    root = F.when(F.col("c_custkey") % 7 == 0, "html").otherwise("svg")
    image = F.concat(F.lit("<"), root, _text(' onload="f()"><g><title> ', "$c_name", " </title><text>", "$c_mktsegment", "<tspan> of ", "$c_nationkey", '</tspan></text></g><script>x</script><text/><text href="u">', "$c_custkey", "</text></"), root, F.lit(">"))
    made = _customers(spark, sf_dir).select(F.col("c_custkey").alias("doc_id"), F.lit("a.SVG").alias("path"), F.encode(image, "utf-8").alias("content"))
    picture = F.decode(F.unbase64(F.substring_index("text", ",", -1)), "utf-8")
    said = F.when(F.col("label") == "picture", F.concat(F.when(picture.rlike("script|onload|href"), "unsafe ").otherwise("safe "), F.length(picture).cast("string"))).otherwise(F.col("text"))
    return _with_faults(files.read_once(made), said)


def _model(key: int, name: str, segment: str) -> bytes:
    nodes = [{"name": name, "children": [1]}, {"mesh": 0, "extras": {"segment": segment}}]
    if key % 5 == 0:
        nodes[1]["children"] = [0]
    model = {"asset": {"version": "2.0"}, "scenes": [{"nodes": [0]}], "nodes": nodes, "meshes": [{"primitives": [{"material": 0}]}], "materials": [{"name": str(key)}]}
    text = json.dumps(model).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", GLB_MARK, 2, len(text) + 32) + struct.pack("<II", len(text), GLB_JSON) + text + struct.pack("<III", 4, GLB_BINARY, 0)


def _models(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = [_model(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["m.glb"] * len(made)), pa.array(made, pa.binary())], names=["doc_id", "path", "content"])


def model_elements(spark, sf_dir):
    """Models of two nodes, a mesh and a material; in every fifth the nodes are below each other."""
    found = files.read_once(_customers(spark, sf_dir).select("c_custkey", "c_name", "c_mktsegment").mapInArrow(_models, "doc_id long, path string, content binary"))
    return _with_faults(found, F.col("text"), "level")


def _mixed(spark, sf_dir):
    """Lines of orders as elements of all kinds, the second of each order as furniture. Lines with one number count as one."""
    li = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", least=LEAST_LINES, most=MOST_LINES).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    k = F.col("p") % 6
    label = F.element_at(F.array(*map(F.lit, ("text", "section_header", "list_item", "code", "table", "picture"))), (k + 1).cast("int"))
    own = F.when(k == 4, _text("| k | v |\n| --- | --- |\n| ", "$p", " | a\\|b |")).otherwise(_text("p ", "$p", ' "q"'))
    zero = F.lit(0)
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), label.alias("label"), F.when(k == 1, F.col("p") % 5 + 1).otherwise(zero).cast("int").alias("level"), F.when(k == 2, F.col("p") % 4).otherwise(zero).cast("int").alias("depth"),
        F.when(F.col("l_linenumber") == 2, "furniture").otherwise("body").alias("layer"), own.alias("text"), F.when(k == 2, F.element_at(F.array(F.lit("-"), F.lit("3.")), (F.col("p") % 2 + 1).cast("int"))).otherwise("").alias("marker"), F.when(k == 3, "SQL").otherwise("").alias("language"),
    )


def tree_round_trip(spark, sf_dir):
    """Elements as JSON trees, read again: the body's in their order and then the furniture's."""
    back = rows.read(tree_json.to_tree(_mixed(spark, sf_dir)), json_documents.parse, text_col="json")
    return back.select("doc_id", "ord", "label", F.col("level").cast("long").alias("level"), F.col("depth").cast("long").alias("depth"), "layer", "text", "marker", "language")


def tree_references(spark, sf_dir):
    """The trees' references, from the JSON itself: kind, number and parent of each text."""
    found = F.from_json("json", "texts array<struct<self_ref:string,parent:struct<`$ref`:string>,children:array<struct<`$ref`:string>>,label:string>>")
    x = tree_json.to_tree(_mixed(spark, sf_dir)).select("doc_id", F.inline(found["texts"]))
    return x.select("doc_id", "self_ref", F.col("parent.`$ref`").alias("parent"), F.size("children").cast("long").alias("children"), "label")


QUERIES = {f.__name__: f for f in (html_cells, vector_elements, model_elements, tree_round_trip, tree_references)}

_MIXED = """x AS (SELECT l_orderkey AS doc_id, l_linenumber AS ord, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
e AS (SELECT *, ['text', 'section_header', 'list_item', 'code', 'table', 'picture'][p % 6 + 1] AS label, ord = 2 AS furniture FROM x)"""

SQL = {
    "tree_round_trip": f"""WITH {_MIXED} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY furniture, ord) - 1 AS ord, label, CAST(CASE WHEN p % 6 = 1 THEN p % 5 + 1 ELSE 0 END AS BIGINT) AS level, CAST(CASE WHEN p % 6 = 2 THEN p % 4 ELSE 0 END AS BIGINT) AS depth,
CASE WHEN furniture THEN 'furniture' ELSE 'body' END AS layer, CASE WHEN p % 6 = 4 THEN '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || p || ' | a\\|b |' ELSE 'p ' || p || ' "q"' END AS text, CASE WHEN p % 6 = 2 THEN ['-', '3.'][p % 2 + 1] ELSE '' END AS marker, CASE WHEN p % 6 = 3 THEN 'SQL' ELSE '' END AS language FROM e""",
    "tree_references": f"""WITH {_MIXED}, k AS (SELECT *, p % 6 < 4 AS is_text, label = 'section_header' AND NOT furniture AS head FROM e),
n AS (SELECT *, '#/texts/' || (count(*) FILTER (is_text) OVER (PARTITION BY doc_id ORDER BY ord) - 1) AS ref FROM k),
h AS (SELECT *, CASE WHEN furniture THEN '#/furniture' WHEN head THEN '#/body' ELSE coalesce(last_value(CASE WHEN head THEN ref END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), '#/body') END AS parent FROM n)
SELECT doc_id, ref AS self_ref, parent, (SELECT count(*) FROM h c WHERE c.doc_id = h.doc_id AND c.parent = h.ref) AS children, label FROM h WHERE is_text""",
    "html_cells": """SELECT c_custkey AS doc_id, CAST(0 AS BIGINT) AS table_no, u.c.r::BIGINT AS row, u.c.c::BIGINT AS col, u.c.h::BIGINT AS row_span, u.c.w::BIGINT AS col_span, u.c.r = 0 AS column_header, u.c.r = 1 AND u.c.c = 0 AS row_header, u.c.t AS text
FROM customer, unnest([{'r': 0, 'c': 0, 'h': 1, 'w': 1, 't': 'key'}, {'r': 0, 'c': 1, 'h': 1, 'w': 2, 't': 'who'}, {'r': 1, 'c': 0, 'h': 2, 'w': 1, 't': CAST(c_custkey AS VARCHAR)}, {'r': 1, 'c': 1, 'h': 1, 'w': 1, 't': c_name || chr(10) || '&'}, {'r': 1, 'c': 2, 'h': 1, 'w': 1, 't': ''}, {'r': 2, 'c': 1, 'h': 1, 'w': 2, 't': CAST(c_nationkey AS VARCHAR)}]) AS u(c)""",
    "vector_elements": """SELECT c_custkey AS doc_id, u.e.ord::BIGINT AS ord, u.e.label AS label, u.e.t AS text FROM customer, unnest([{'ord': 0, 'label': 'title', 't': c_name}, {'ord': 1, 'label': 'text', 't': c_mktsegment || ' of ' || c_nationkey}, {'ord': 2, 'label': 'text', 't': CAST(c_custkey AS VARCHAR)},
 {'ord': 3, 'label': 'picture', 't': 'safe ' || length('<svg><g><title> ' || c_name || ' </title><text>' || c_mktsegment || '<tspan> of ' || c_nationkey || '</tspan></text></g><text /><text>' || c_custkey || '</text></svg>')}]) AS u(e) WHERE c_custkey % 7 > 0
UNION ALL SELECT c_custkey, -1, 'fault', 'ValueError: root element html instead of svg' FROM customer WHERE c_custkey % 7 = 0""",
    "model_elements": """WITH s AS (SELECT c_custkey, ['三维模型信息', '格式：GLB / glTF 2.0；场景：1；节点：2；网格：1；渲染材质：1', '本解析结果提取模型结构与已有属性，不包含几何渲染或工程材料推断。', '场景[0]', '模型来源：#/scenes/0', '根节点：节点[0] ' || c_name, '节点[0] ' || c_name, '模型来源：#/nodes/0', '子节点：节点[1]',
 '节点[1]', '模型来源：#/nodes/1', '父节点：节点[0] ' || c_name, '引用网格：网格[0]', '自定义属性（#/nodes/1/extras）：segment = "' || c_mktsegment || '"', '网格[0]', '模型来源：#/meshes/0', '图元数量：1', '图元[0] 渲染材质：渲染材质[0] ' || c_custkey, '渲染材质[0] ' || c_custkey, '模型来源：#/materials/0'] AS t FROM customer WHERE c_custkey % 5 > 0),
e AS (SELECT c_custkey AS doc_id, unnest(t) AS text, generate_subscripts(t, 1) - 1 AS ord FROM s)
SELECT doc_id, ord, CASE WHEN ord IN (0, 3, 6, 9, 14, 18) THEN 'section_header' ELSE 'text' END AS label, CAST(CASE WHEN ord = 0 THEN 1 WHEN ord IN (3, 6, 9, 14, 18) THEN 2 ELSE 0 END AS BIGINT) AS level, text FROM e
UNION ALL SELECT c_custkey, -1, 'fault', 0, 'ValueError: references of a model file' FROM customer WHERE c_custkey % 5 = 0""",
}
