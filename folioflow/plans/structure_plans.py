"""Queries over lines, tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import table as tb
from folioflow.functions.text import garbage_ratio, mime_type, origin_hash, semantic_units
from folioflow.operators import layout
from folioflow.sources import csv_tables
from folioflow.streaming import events as ev


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_measures(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(garbage_ratio(F.col("text")), 6).alias("garbage"), origin_hash(F.col("text")).cast("string").alias("origin_hash"), F.size(semantic_units(F.col("text"))).cast("long").alias("units"))


def mime_types(spark, sf_dir):
    names = F.concat(F.lit("part"), F.col("p_partkey"), F.element_at(F.array(*map(F.lit, (".PDF", ".md", ".bin", ".html"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    return _t(spark, sf_dir, "part").select("p_partkey", mime_type(names).alias("mime"))


def _lines(spark, sf_dir):
    """Documents as pages of their source, under a head in plain or full-width letters and over a foot."""
    head = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Report on "), "source")).otherwise(F.concat(F.lit("Ｒeport  on"), "source"))
    d = _t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page_no"), F.posexplode(F.split(F.concat(head, F.lit("\n"), "text", F.lit("\nthe end")), "\n")).alias("ord", "text"))
    return d.select(F.col("source").alias("doc_id"), "page_no", (-F.col("ord")).cast("double").alias("y"), F.col("ord").cast("long").alias("ord"), "text")


def furniture_lines(spark, sf_dir):
    return layout.furniture(_lines(spark, sf_dir)).where("label is not null").select("doc_id", "page_no", "ord", "label")


def toc_regions(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("ord"), F.when(F.col("p_size") % 3 < 2, F.concat("p_name", F.lit(" ..... "), F.col("p_size"))).otherwise(F.col("p_name")).alias("text"))
    return layout.toc_regions(p).select("doc_id", "ord", "in_toc")


def heading_ranks(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return layout.heading_ranks(lines, ["l_orderkey"], "l_quantity").select("l_orderkey", "l_linenumber", F.col("level").cast("long").alias("level"))


def font_medians(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    return layout.upper_median(lines, ["l_orderkey"], "l_quantity").join(layout.mode(lines, ["l_orderkey"], "l_quantity"), "l_orderkey")


def table_gfm(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.array(F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), F.col("n_name"), F.lit(""), F.col("n_name")))).alias("rows"))
    clean = tb.with_separator(tb.merge_equal_neighbours(tb.drop_empty_columns(tb.drop_empty_rows("rows"))))
    return n.select("n_regionkey", tb.render_gfm(clean).alias("gfm"))


def a1_columns(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    name = F.concat(F.char(F.col("p_partkey") % 26 + 65), F.char(F.col("p_size") % 26 + 65))
    return p.select("p_partkey", tb.a1_column(name).alias("col"))


def csv_cells(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(";", F.lpad(F.col("n_nationkey").cast("string"), 3, "0"), "n_name"))), "\n").alias("text"))
    return csv_tables.cells(n.select(F.col("n_regionkey").alias("doc_id"), F.concat(F.lit("key;name\n"), F.col("text")).alias("text"))).select("doc_id", "row", "col", "text", "column_header")


def events_tumbling(spark, sf_dir):
    return ev.tumbling(_t(spark, sf_dir, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def events_sessions(spark, sf_dir):
    return ev.sessions(_t(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (text_measures, mime_types, furniture_lines, toc_regions, heading_ranks, font_medians, table_gfm, a1_columns, csv_cells, events_tumbling, events_sessions)}

SQL = {
    "text_measures": r"""SELECT doc_id, round(length(regexp_replace(text, '[^\x{FFFD}\p{Cc}\p{Co}]|[\x09-\x0D\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]', '', 'g')) / greatest(length(regexp_replace(text, '[\x09-\x0D\x20\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]', '', 'g')), 1), 6) AS garbage,
CAST(CAST('0x' || right(sha256(text), 16) AS UBIGINT) AS VARCHAR) AS origin_hash, CAST(len(regexp_extract_all(text, '[^\n。！？；.!?;]*[\n。！？；.!?;]|[^\n。！？；.!?;]+$')) AS BIGINT) AS units FROM documents""",
    "mime_types": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/markdown' WHEN 3 THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM part",
    "furniture_lines": r"""
WITH t AS (SELECT source, doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Report on ' ELSE 'Ｒeport  on' END || source || chr(10) || text || chr(10) || 'the end' AS text FROM documents),
l AS (SELECT source AS doc_id, doc_id AS page_no, unnest(range(0, len(string_split(text, chr(10))))) AS ord, unnest(string_split(text, chr(10))) AS text FROM t),
e AS (SELECT *, -ord AS y, max(-ord) OVER p AS top, min(-ord) OVER p AS low, replace(regexp_replace(text, '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', '', 'g'), 'Ｒ', 'R') AS f FROM l WINDOW p AS (PARTITION BY doc_id, page_no)),
z AS (SELECT *, CASE WHEN length(text) > 100 OR f = '' THEN NULL WHEN y >= top - CAST(0.15 AS DOUBLE) * (top - low) THEN 'page_header' WHEN y <= low + CAST(0.15 AS DOUBLE) * (top - low) THEN 'page_footer' END AS label FROM e),
n AS (SELECT doc_id, count(DISTINCT page_no) AS pages FROM l GROUP BY doc_id),
o AS (SELECT z.doc_id, label, f FROM z JOIN n ON n.doc_id = z.doc_id WHERE label IS NOT NULL GROUP BY z.doc_id, label, f, pages HAVING pages >= 3 AND count(DISTINCT page_no) >= ceil(pages * CAST(0.6 AS DOUBLE)))
SELECT doc_id, page_no, ord, label FROM z SEMI JOIN o USING (doc_id, label, f)""",
    "toc_regions": r"""
WITH l AS (SELECT p_brand AS doc_id, p_partkey AS ord, p_size % 3 < 2 AS hit, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part),
h AS (SELECT doc_id, n, sum(CASE WHEN n - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM (SELECT doc_id, n, lag(n, 1, -9) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM l WHERE hit)),
r AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM h GROUP BY doc_id, run HAVING count(*) >= 3)
SELECT l.doc_id, ord, EXISTS (SELECT 1 FROM r WHERE r.doc_id = l.doc_id AND n BETWEEN a AND b) AS in_toc FROM l""",
    "heading_ranks": "SELECT l_orderkey, l_linenumber, CAST(least(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC), 3) AS BIGINT) AS level FROM lineitem",
    "font_medians": """WITH c AS (SELECT l_orderkey, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT l_orderkey, l_quantity AS mode FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_quantity DESC) = 1)
SELECT l.l_orderkey, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median, any_value(mode) AS mode FROM lineitem l JOIN m ON m.l_orderkey = l.l_orderkey GROUP BY l.l_orderkey""",
    "table_gfm": """WITH r AS (SELECT n_regionkey, n_nationkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, '| ' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || ' | ' || n_name || ' |' AS line FROM nation)
SELECT n_regionkey, string_agg(CASE WHEN k = 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY k) AS gfm FROM r GROUP BY n_regionkey""",
    "a1_columns": "SELECT p_partkey, (p_partkey % 26 + 1) * 26 + p_size % 26 AS col FROM part",
    "csv_cells": """WITH r AS (SELECT n_regionkey AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS row, lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS a, n_name AS b FROM nation UNION ALL SELECT DISTINCT n_regionkey, 0, 'key', 'name' FROM nation)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(row AS BIGINT) AS row, CAST(0 AS BIGINT) AS col, a AS text, row = 0 AS column_header FROM r UNION ALL SELECT doc_id, row, 1, b, row = 0 FROM r""",
    "events_tumbling": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sessions": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
}
