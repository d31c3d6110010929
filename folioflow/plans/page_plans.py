"""Queries over pages, cells and recognised texts, files and budgeted chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import geometry, table, text
from folioflow.operators import chunks, document, exports, pages
from folioflow.operators.tables import LEAST_LINES, MOST_LINES, spread
from folioflow.plans.document_plans import _orders
from folioflow.sources import asciidoc, files, html_pages


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_forms(spark, sf_dir):
    t = F.col("text")
    d = _t(spark, sf_dir, "documents")
    return d.select("doc_id", text.first_line(t, 40).alias("head"), F.round(text.formula_density(t), 6).alias("density"), F.round(text.width_estimate(t), 2).alias("width"), F.length(text.trim_line_ends(t)).cast("long").alias("trimmed"), text.has_cjk(t).alias("cjk"))


def recognised_faults(spark, sf_dir):
    """The whole text of each document as a recogniser's result, with lines said again and again before every fifth and an apology before every seventh."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("one line\n" * 4), "text")).when(F.col("doc_id") % 7 == 0, F.concat(F.lit("I'm sorry, "), "text")).otherwise(F.col("text")).alias("t"))
    return d.select("doc_id", F.coalesce(pages.recognised_fault(F.col("t")), F.lit("good")).alias("fault"))


def _lines(spark, sf_dir):
    """Order lines as lines on a page: an order is a page."""
    x = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", least=LEAST_LINES, most=MOST_LINES).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").alias("q"))
    left, top = (F.col("p") % 40).cast("double"), (F.col("q") * 2).cast("double")
    return x.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("ord"), left.alias("l"), (left + 10).alias("r"), top.alias("t"), (top - 6).alias("b"))


def page_order(spark, sf_dir):
    return pages.reading_order(_lines(spark, sf_dir).withColumnsRenamed({"t": "max_y", "l": "min_x"}), ["page"]).select("page", "ord", "place")


def shape_order(spark, sf_dir):
    return pages.shape_rows(_lines(spark, sf_dir).withColumnsRenamed({"t": "top", "l": "left"}), ["page"], 4.0).select("page", "ord", F.col("row").cast("long").alias("row"), "place")


def largest_pictures(spark, sf_dir):
    sized = _lines(spark, sf_dir).withColumn("r", F.col("l") + F.col("t"))
    return pages.largest_pictures(sized, ["page"], 2).select("page", "ord")


def covered_areas(spark, sf_dir):
    return pages.covered_area(_lines(spark, sf_dir), ["page"]).select("page", F.round("area", 4).alias("area"))


def outside_boxes(spark, sf_dir):
    x = _lines(spark, sf_dir)
    lines = x.where("ord > 1").withColumnsRenamed({"l": "min_x", "r": "max_x", "b": "min_y", "t": "max_y"})
    return pages.outside_boxes(lines, x.where("ord = 1").withColumn("r", F.col("l") + 25).withColumn("b", F.lit(0.0))).select("page", "ord")


def overlap_shares(spark, sf_dir):
    x = _lines(spark, sf_dir)
    box = lambda p: F.struct(*(F.col(f"{p}.{c}").alias(c) for c in "ltrb"))
    met = x.alias("p").join(x.alias("q"), (F.col("p.page") == F.col("q.page")) & (F.col("p.ord") < F.col("q.ord")))
    return met.select(F.col("p.page").alias("page"), F.col("p.ord").alias("a"), F.col("q.ord").alias("b"), F.round(geometry.overlap_share(box("p"), box("q")), 6).alias("share")).where("share >= 0.25")


def row_cells(spark, sf_dir):
    words = _lines(spark, sf_dir).select("page", F.col("l").alias("min_x"), (F.col("l") + 3).alias("max_x"), F.lit(5.0).alias("font"), F.col("ord").cast("string").alias("text"))
    return pages.row_cells(words, ["page"]).groupBy("page").agg(F.count("*").alias("cells"), F.min("min_x").alias("l"), F.max("max_x").alias("r"))


def table_sizes(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    body = n.select("n_regionkey", F.concat(F.lit("| name | size |\n| --- | --- |\n"), F.array_join(F.transform("names", lambda x: F.concat(F.lit("| "), x, F.lit(" | "), F.length(x).cast("string"), F.lit(" |"))), "\n")).alias("b"))
    return body.select("n_regionkey", table.size_estimate(F.col("b")).alias("s"), F.size(table.parse_gfm(F.col("b"))).cast("long").alias("parsed")).select("n_regionkey", "s.n_rows", "s.n_cols", "parsed")


def blanked_repeats(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_mktsegment"))), lambda x: F.array(x["c_custkey"].cast("string"), x["c_mktsegment"])).alias("rows"))
    cells = F.filter(F.flatten(F.transform(table.blank_repeats(F.col("rows")), lambda r: F.slice(r, 2, 1))), lambda x: x != "")
    return c.select("c_nationkey", F.size(cells).cast("long").alias("said"))


def cell_grids(spark, sf_dir):
    x = _lines(spark, sf_dir).select("page", F.col("ord").alias("idx"), (F.col("ord") - 1).alias("r0"), (F.col("ord") + 1).alias("r1"), F.lit(0).cast("long").alias("c0"), F.lit(2).cast("long").alias("c1"), F.col("ord").cast("string").alias("text"))
    return pages.grids(x, ["page"]).select("page", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("grid"))


def assembled_lines(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select(F.col("p_size").alias("page"), (F.col("p_partkey") * 6).cast("double").alias("x"), F.lit(5.0).alias("y"), F.lit(5.0).alias("w"), F.substr("p_name", F.lit(1), F.lit(1)).alias("text"))
    return pages.assembled_lines(p, ["page"]).select("page", "line", "text")


def budgeted_chunks(spark, sf_dir):
    return chunks.budgeted(chunks.hierarchical(_orders(spark, sf_dir)), 48).select("doc_id", "chunk_no", F.array_join("headings", " > ").alias("path"), "text")


def unmerged_chunks(spark, sf_dir):
    """Chunks without headings and of one sentence each: what a budget cuts is what fixed pieces are."""
    d = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).cast("long").alias("chunk_no"), F.array().cast("array<string>").alias("headings"), F.regexp_replace("p_name", r"[.!?;\n]", " ").alias("text"), F.lit("text").alias("label"))
    return chunks.budgeted(d, 5, merge=False).select("doc_id", "chunk_no", "text")


def html_export(spark, sf_dir):
    return exports.to_html(html_pages.read(_t(spark, sf_dir, "pages")))


def json_export(spark, sf_dir):
    return exports.to_json(_orders(spark, sf_dir))


def items_markdown(spark, sf_dir):
    items = document.content_items(_orders(spark, sf_dir)).withColumn("label", F.lit(None).cast("string"))
    return exports.items_markdown(items)


def asciidoc_elements(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("doc_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("n_name")), lambda x: F.concat(F.lit("* "), x)), "\n").alias("items"))
    return asciidoc.read(n.select("doc_id", F.concat(F.lit("= Nations\n\nAll of them\n\n== List\n\n"), "items").alias("text"))).select("doc_id", "ord", "label", "text")


def files_by_extension(spark, sf_dir):
    p = _t(spark, sf_dir, "part")
    path = F.concat(F.lit("f"), F.col("p_partkey"), F.element_at(F.array(*map(F.lit, (".TXT", ".md", ".adoc", ".bin"))), (F.col("p_partkey") % 4 + 1).cast("int")))
    head = F.element_at(F.array(*map(F.lit, ("", "# ", "= ", ""))), (F.col("p_partkey") % 4 + 1).cast("int"))
    found, faults = files.read(p.select(F.col("p_partkey").alias("doc_id"), path.alias("path"), F.encode(F.concat(head, "p_name"), "utf-8").alias("content")))
    return found.select("doc_id", "label", "text").unionByName(faults.select("doc_id", F.lit("fault").alias("label"), F.col("error").alias("text")))


QUERIES = {f.__name__: f for f in (text_forms, recognised_faults, page_order, shape_order, largest_pictures, covered_areas, outside_boxes, overlap_shares, row_cells, table_sizes, blanked_repeats, cell_grids, assembled_lines, budgeted_chunks, unmerged_chunks, html_export, json_export, items_markdown, asciidoc_elements, files_by_extension)}

_PAGE = """l AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS ord, CAST(min(l_partkey) % 40 AS DOUBLE) AS l, CAST(min(l_partkey) % 40 AS DOUBLE) + 10 AS r, min(l_quantity) * 2 AS t, min(l_quantity) * 2 - 6 AS b FROM lineitem GROUP BY l_orderkey, l_linenumber)"""

SQL = {
    "text_forms": r"""WITH d AS (SELECT doc_id, text, trim(split_part(text, chr(10), 1), ' ' || chr(9) || chr(13)) AS line, length(regexp_replace(text, '[\x{0}-\x{2E7F}]', '', 'g')) AS wide, length(regexp_replace(text, '[\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]', '', 'g')) AS solid FROM documents)
SELECT doc_id, CASE WHEN length(line) > 40 THEN left(line, 40) || '…' ELSE line END AS head, round(CASE WHEN solid > 0 THEN len(regexp_extract_all(text, '[=∑∏√∫≈≠≤≥±×÷∞∂∆∇∈∉⊂⊃∪∩^_{}\[\]\p{Sm}]')) / solid ELSE 0.0 END, 6) AS density,
round(CAST(greatest(1.0, wide + 0.55 * (length(text) - wide)) AS DOUBLE), 2) AS width, length(regexp_replace(text, '(?m)[ \t]+$', '', 'g')) AS trimmed, regexp_matches(text, '[\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]') AS cjk FROM d""",
    "page_order": f"WITH {_PAGE} SELECT page, ord, row_number() OVER (PARTITION BY page ORDER BY t DESC, l, ord) AS place FROM l",
    "shape_order": f"WITH {_PAGE}, a AS (SELECT *, CASE WHEN t - lag(t) OVER w > 4 THEN 1 ELSE 0 END AS n FROM l WINDOW w AS (PARTITION BY page ORDER BY t, ord)), g AS (SELECT *, CAST(sum(n) OVER (PARTITION BY page ORDER BY t, ord ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row FROM a) SELECT page, ord, row, row_number() OVER (PARTITION BY page ORDER BY row, l, ord) AS place FROM g",
    "largest_pictures": f"WITH {_PAGE} SELECT page, ord FROM l QUALIFY row_number() OVER (PARTITION BY page ORDER BY t * 6 DESC, t DESC, ord) <= 2",
    "covered_areas": f"WITH {_PAGE}, p AS (SELECT page, l + i AS x, b + j AS y FROM l, range(0, 10) AS a(i), range(0, 6) AS c(j) GROUP BY ALL) SELECT page, CAST(count(*) AS DOUBLE) AS area FROM p GROUP BY page",
    "outside_boxes": f"WITH {_PAGE} SELECT page, ord FROM l WHERE ord > 1 AND NOT EXISTS (SELECT 1 FROM l q WHERE q.page = l.page AND q.ord = 1 AND (l.l + l.r) / 2 BETWEEN q.l AND q.l + 25 AND (l.t + l.b) / 2 BETWEEN 0 AND q.t)",
    "overlap_shares": f"WITH {_PAGE} SELECT p.page, p.ord AS a, q.ord AS b, round(greatest(least(p.r, q.r) - greatest(p.l, q.l), 0) * greatest(least(p.t, q.t) - greatest(p.b, q.b), 0) / 60, 6) AS share FROM l p JOIN l q ON p.page = q.page AND p.ord < q.ord WHERE round(greatest(least(p.r, q.r) - greatest(p.l, q.l), 0) * greatest(least(p.t, q.t) - greatest(p.b, q.b), 0) / 60, 6) >= 0.25",
    "row_cells": f"WITH {_PAGE}, g AS (SELECT page, l, CASE WHEN l - (max(l + 3) OVER (PARTITION BY page ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) >= 10 THEN 1 ELSE 0 END AS n FROM l) SELECT page, CAST(1 + sum(n) AS BIGINT) AS cells, min(l) AS l, max(l) + 3 AS r FROM g GROUP BY page",
    "table_sizes": "SELECT n_regionkey, count(*) + 1 AS n_rows, CAST(2 AS BIGINT) AS n_cols, count(*) + 1 AS parsed FROM nation GROUP BY n_regionkey",
    "blanked_repeats": "WITH c AS (SELECT c_nationkey, c_custkey, c_mktsegment AS s, CASE WHEN c_mktsegment = lag(c_mktsegment) OVER w THEN 0 ELSE 1 END AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)), g AS (SELECT *, sum(n) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS UNBOUNDED PRECEDING) AS run FROM c), k AS (SELECT c_nationkey, run, count(*) AS n FROM g GROUP BY c_nationkey, run) SELECT c_nationkey, CAST(sum((n + 1) // 2) AS BIGINT) AS said FROM k GROUP BY c_nationkey",
    "cell_grids": f"WITH {_PAGE}, c AS (SELECT page, ord, u.k AS r FROM l, unnest([ord - 1, ord]) AS u(k)), w AS (SELECT page, r, max(ord) AS v FROM c GROUP BY page, r), s AS (SELECT g.page, g.r FROM (SELECT page, unnest(range(0, max(r) + 1)) AS r FROM w GROUP BY page) AS g) SELECT s.page, string_agg(coalesce(v || '|' || v, '|'), '/' ORDER BY s.r) AS grid FROM s LEFT JOIN w ON w.page = s.page AND w.r = s.r GROUP BY s.page",
    "assembled_lines": "WITH p AS (SELECT p_size AS page, p_partkey, left(p_name, 1) AS c, p_partkey - lag(p_partkey) OVER (PARTITION BY p_size ORDER BY p_partkey) AS d FROM part) SELECT page, CAST(0 AS BIGINT) AS line, string_agg(CASE WHEN d > 1 THEN ' ' || c ELSE c END, '' ORDER BY p_partkey) AS text FROM p GROUP BY page",
    "unmerged_chunks": r"WITH p AS (SELECT p_partkey AS doc_id, regexp_replace(p_name, '[.!?;\n]', ' ', 'g') AS t FROM part) SELECT doc_id, CAST(k AS BIGINT) AS chunk_no, substr(t, CAST(k * 5 + 1 AS BIGINT), 5) AS text FROM p, range(0, 20) AS r(k) WHERE k * 5 < length(t)",
    "items_markdown": None,
    "asciidoc_elements": "WITH h AS (SELECT DISTINCT CAST(n_regionkey AS BIGINT) AS doc_id FROM nation) SELECT doc_id, CAST(0 AS BIGINT) AS ord, 'title' AS label, 'Nations' AS text FROM h UNION ALL SELECT doc_id, 1, 'text', 'All of them' FROM h UNION ALL SELECT doc_id, 2, 'section_header', 'List' FROM h UNION ALL SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) + 2, 'list_item', n_name FROM nation",
    "files_by_extension": "SELECT p_partkey AS doc_id, CASE p_partkey % 4 WHEN 0 THEN 'text' WHEN 3 THEN 'fault' ELSE 'title' END AS label, CASE p_partkey % 4 WHEN 3 THEN 'unknown format' ELSE p_name END AS text FROM part",
}
SQL = {name: sql for name, sql in SQL.items() if sql}
