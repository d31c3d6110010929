"""Queries over documents, elements and the joins between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import chunks, document, places
from folioflow.operators.tables import LEAST_LINES, MOST_LINES, spread
from folioflow.sources import html_pages, mail, markdown


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark, sf_dir):
    """Lines of orders as elements: quantities give labels and levels. Lines with one number count as one."""
    lines = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_orderkey", least=LEAST_LINES, most=MOST_LINES).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("l_partkey"))
    q = F.col("q")
    label = F.when(q % 5 == 0, "section_header").when(q % 17 == 0, "title").when(q % 5 == 1, "list_item").when(q % 5 == 2, "code").otherwise("text")
    level = F.when(q % 5 == 0, F.pmod(q, F.lit(3)) + 1).otherwise(0)
    return lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("ord"), label.alias("label"), level.alias("level"), F.lit(0).alias("depth"), F.lit("body").alias("layer"), F.concat(F.lit("Part "), "l_partkey").alias("text"), F.lit("-").alias("marker"), F.lit("").alias("language"))


def section_paths(spark, sf_dir):
    return document.section_paths(_orders(spark, sf_dir)).select("doc_id", "ord", F.array_join("section_path", " > ").alias("path"))


def heading_contexts(spark, sf_dir):
    return document.heading_contexts(_orders(spark, sf_dir)).select("doc_id", "ord", F.array_join("headings", " > ").alias("path"))


def hierarchical_chunks(spark, sf_dir):
    return chunks.hierarchical(_orders(spark, sf_dir)).select("doc_id", "chunk_no", F.array_join("headings", " > ").alias("path"), "text")


def item_chunks(spark, sf_dir):
    return chunks.content(document.content_items(html_pages.read(_t(spark, sf_dir, "pages"))))


def content_items(spark, sf_dir):
    return document.content_items(_orders(spark, sf_dir)).select("doc_id", "order_index", "type", "text", F.coalesce("text_level", F.lit(0)).alias("text_level"))


def section_filter(spark, sf_dir):
    return document.in_section(document.content_items(_orders(spark, sf_dir)), section="7").groupBy("doc_id").agg(F.count("*").alias("n"))


def outlines(spark, sf_dir):
    return document.outline(document.content_items(_orders(spark, sf_dir))).select("doc_id", "n_items", "n_headings", F.array_join("groups", "|").alias("groups"))


def markdown_export(spark, sf_dir):
    return document.to_markdown(_orders(spark, sf_dir))


def plain_texts(spark, sf_dir):
    return document.plain_text(_orders(spark, sf_dir))


def _guide(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    item = F.array_join(F.transform("n", lambda x: F.concat(F.lit("- **"), x["n_name"], F.lit("**"))), "\n")
    return n.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# Region "), "n_regionkey", F.lit("\n\nIts *nations*:\n\n"), item, F.lit("\n\n## Code\n\n```sql\nSELECT 1\n```\n")).alias("text"))


def markdown_elements(spark, sf_dir):
    return markdown.read(_guide(spark, sf_dir)).select("doc_id", "ord", "label", "level", "text", "language")


def document_markdown(spark, sf_dir):
    return markdown.read(_t(spark, sf_dir, "documents"))


def html_elements(spark, sf_dir):
    return html_pages.read(_t(spark, sf_dir, "pages"))


def html_markdown(spark, sf_dir):
    return document.to_markdown(html_pages.read(_t(spark, sf_dir, "pages")))


def mail_elements(spark, sf_dir):
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    raw = F.concat(F.lit("Subject: Account of "), "c_name", F.lit("\nFrom: a@example.org\nTo: b@example.org\nContent-Type: text/plain; charset=utf-8\n\nSegment "), "c_mktsegment", F.lit("\n\nBye\n"))
    return mail.read(c.select("c_custkey", raw.alias("text")), "c_custkey").select("doc_id", "ord", "label", "text")


def heading_shapes(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", places.looks_like_heading(F.col("text")).alias("heading"))


def caption_texts(spark, sf_dir):
    lines = _orders(spark, sf_dir)
    refs = lines.where("label = 'code'").select("doc_id", F.col("ord").alias("ref"), F.posexplode(F.array(F.col("ord") + 1, F.col("ord") - 1)).alias("pos", "target"))
    return places.captions(refs, lines)


def caption_rest(spark, sf_dir):
    lines = _orders(spark, sf_dir)
    refs = lines.where("label = 'code'").select("doc_id", (F.col("ord") + 1).alias("target"))
    return places.not_captions(lines, refs).select("doc_id", "ord")


def reply_roots(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("id"))
    number = F.row_number().over(document.Window.partitionBy("doc_id").orderBy("id"))
    parent = F.lag("id").over(document.Window.partitionBy("doc_id").orderBy("id"))
    return places.reply_roots(o.withColumn("k", number).withColumn("parent", F.when(F.col("k") % 4 != 1, parent)).drop("k"))


def _boxes(spark, sf_dir):
    w = F.col("p_size")
    return _t(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("page"), F.col("p_partkey").alias("ref"), w.alias("l"), (w % 7).alias("t"), (w + 5).alias("r"), (w % 7 + 3).alias("b"))


def _points(spark, sf_dir):
    return _t(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("page"), F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 51).alias("x"), (F.col("s_suppkey") % 8).alias("y"))


def nearest_elements(spark, sf_dir):
    return places.nearest(_points(spark, sf_dir), _boxes(spark, sf_dir))


def covering_tables(spark, sf_dir):
    return places.covering(_points(spark, sf_dir), _boxes(spark, sf_dir)).withColumn("ref", F.coalesce("ref", F.lit(-1)))


def page_envelopes(spark, sf_dir):
    return places.envelope(_boxes(spark, sf_dir), ["page"])


QUERIES = {f.__name__: f for f in (section_paths, heading_contexts, hierarchical_chunks, item_chunks, content_items, section_filter, outlines, markdown_export, plain_texts, markdown_elements, document_markdown, html_elements, html_markdown, mail_elements, heading_shapes, caption_texts, caption_rest, reply_roots, nearest_elements, covering_tables, page_envelopes)}

_LINES = """l AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, CAST(min(l_quantity) AS INT) AS q, 'Part ' || min(l_partkey) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber),
e AS (SELECT *, CASE WHEN q % 5 = 0 THEN 'section_header' WHEN q % 17 = 0 THEN 'title' WHEN q % 5 = 1 THEN 'list_item' WHEN q % 5 = 2 THEN 'code' ELSE 'text' END AS label, CASE WHEN q % 5 = 0 THEN q % 3 + 1 ELSE 0 END AS level FROM l),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k, CASE label WHEN 'title' THEN 1 ELSE level + 1 END AS depth FROM e WHERE label IN ('title', 'section_header')),
w AS (SELECT doc_id, k, ord, [text] AS path FROM h WHERE k = 1 UNION ALL SELECT h.doc_id, h.k, h.ord, list_concat(list_slice(w.path, 1, depth - 1), [text]) FROM w JOIN h ON h.doc_id = w.doc_id AND h.k = w.k + 1),
s AS (SELECT e.doc_id, e.ord, e.text, coalesce(arg_max(path, w.ord), []) AS path FROM e LEFT JOIN w ON w.doc_id = e.doc_id AND w.ord <= e.ord GROUP BY ALL),
p AS (SELECT e.doc_id, e.ord, h.ord AS pos, h.text FROM e JOIN h ON h.doc_id = e.doc_id AND h.ord <= e.ord AND NOT EXISTS (SELECT 1 FROM h g WHERE g.doc_id = h.doc_id AND g.ord > h.ord AND g.ord <= e.ord AND g.level <= h.level))"""
_BOXES = """b AS (SELECT p_partkey % 50 AS page, p_partkey AS ref, p_size AS l, p_size % 7 AS t, p_size + 5 AS r, p_size % 7 + 3 AS b FROM part),
s AS (SELECT s_suppkey % 50 AS page, s_suppkey AS id, s_suppkey % 51 AS x, s_suppkey % 8 AS y FROM supplier)"""

SQL = {
    "section_paths": f"WITH RECURSIVE {_LINES} SELECT doc_id, ord, array_to_string(path, ' > ') AS path FROM s",
    "hierarchical_chunks": f"""WITH RECURSIVE {_LINES}, c AS (SELECT e.doc_id, e.ord, e.label, e.text, coalesce(string_agg(p.text, ' > ' ORDER BY pos), '') AS path FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.ord = e.ord WHERE e.label NOT IN ('title', 'section_header') GROUP BY ALL),
j AS (SELECT *, CASE WHEN label = 'list_item' AND lag(label) OVER o = 'list_item' AND lag(path) OVER o = path THEN 0 ELSE 1 END AS new FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY ord)), k AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM j)
SELECT doc_id, CAST(n - 1 AS BIGINT) AS chunk_no, any_value(path) AS path, string_agg(CASE label WHEN 'list_item' THEN '- ' ELSE '' END || text, chr(10) ORDER BY ord) AS text FROM k GROUP BY doc_id, n""",
    "heading_contexts": f"WITH RECURSIVE {_LINES} SELECT e.doc_id, e.ord, coalesce(string_agg(p.text, ' > ' ORDER BY pos), '') AS path FROM e LEFT JOIN p ON p.doc_id = e.doc_id AND p.ord = e.ord GROUP BY e.doc_id, e.ord",
    "content_items": f"WITH RECURSIVE {_LINES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS order_index, CASE label WHEN 'code' THEN 'code' ELSE 'text' END AS type, text, CAST(CASE label WHEN 'title' THEN 1 WHEN 'section_header' THEN level + 1 ELSE 0 END AS BIGINT) AS text_level FROM e",
    "section_filter": f"WITH RECURSIVE {_LINES} SELECT doc_id, count(*) AS n FROM s WHERE len(list_filter(path, lambda x: contains(x, '7'))) > 0 GROUP BY doc_id",
    "outlines": f"""WITH RECURSIVE {_LINES}, f AS (SELECT doc_id, ord, path[1] AS g FROM s WHERE len(path) > 0), k AS (SELECT doc_id, g, min(ord) AS pos FROM f GROUP BY doc_id, g), j AS (SELECT doc_id, string_agg(g, '|' ORDER BY pos) AS groups FROM k GROUP BY doc_id)
SELECT e.doc_id, count(*) AS n_items, count(*) FILTER (label IN ('title', 'section_header')) AS n_headings, coalesce(any_value(groups), '') AS groups FROM e LEFT JOIN j ON j.doc_id = e.doc_id GROUP BY e.doc_id""",
    "markdown_export": f"""WITH RECURSIVE {_LINES}, m AS (SELECT doc_id, ord, label, lag(label) OVER (PARTITION BY doc_id ORDER BY ord) AS prev, CASE label WHEN 'title' THEN '# ' || text WHEN 'section_header' THEN repeat('#', level) || ' ' || text WHEN 'list_item' THEN '- ' || text WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END AS md FROM e)
SELECT doc_id, string_agg(CASE WHEN prev IS NULL THEN '' WHEN prev = 'list_item' AND label = 'list_item' THEN chr(10) ELSE chr(10) || chr(10) END || md, '' ORDER BY ord) || chr(10) AS markdown FROM m GROUP BY doc_id""",
    "plain_texts": f"WITH RECURSIVE {_LINES} SELECT doc_id, string_agg(text, chr(10) ORDER BY ord) AS text FROM e GROUP BY doc_id",
    "markdown_elements": """WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k, count(*) OVER (PARTITION BY n_regionkey) AS c, n_name FROM nation), r AS (SELECT DISTINCT doc_id, c FROM n)
SELECT doc_id, 0 AS ord, 'title' AS label, 0 AS level, 'Region ' || doc_id AS text, '' AS language FROM r UNION ALL SELECT doc_id, 1, 'text', 0, 'Its nations:', '' FROM r UNION ALL SELECT doc_id, k + 1, 'list_item', 0, n_name, '' FROM n
UNION ALL SELECT doc_id, c + 2, 'section_header', 1, 'Code', '' FROM r UNION ALL SELECT doc_id, c + 3, 'code', 0, 'SELECT 1', 'sql' FROM r""",
    "mail_elements": "SELECT CAST(c_custkey AS BIGINT) AS doc_id, unnest([0, 1, 2, 3, 4]) AS ord, unnest(['title', 'text', 'text', 'text', 'text']) AS label, unnest(['Account of ' || c_name, 'From: a@example.org', 'To: b@example.org', 'Segment ' || c_mktsegment, 'Bye']) AS text FROM customer",
    "heading_shapes": "SELECT doc_id, length(text) <= 50 AND NOT regexp_matches(text, '[。？！；.?!]') AND NOT regexp_matches(text, '[：:]$') AS heading FROM documents",
    "caption_texts": f"WITH RECURSIVE {_LINES} SELECT c.doc_id, c.ord AS ref, coalesce(a.text, '') || coalesce(b.text, '') AS caption FROM e c LEFT JOIN e a ON a.doc_id = c.doc_id AND a.ord = c.ord + 1 LEFT JOIN e b ON b.doc_id = c.doc_id AND b.ord = c.ord - 1 WHERE c.label = 'code'",
    "caption_rest": f"WITH RECURSIVE {_LINES} SELECT doc_id, ord FROM e WHERE NOT EXISTS (SELECT 1 FROM e c WHERE c.doc_id = e.doc_id AND c.label = 'code' AND c.ord + 1 = e.ord)",
    "reply_roots": "WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS id, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 4 AS g FROM orders) SELECT doc_id, id, min(id) OVER (PARTITION BY doc_id, g) AS root FROM o",
    "nearest_elements": f"WITH {_BOXES} SELECT s.page, id, arg_min(ref, ((x - (l + r) / 2) ** 2 + (y - (t + b) / 2) ** 2) * 1000000000 + ref) AS ref FROM s JOIN b ON b.page = s.page GROUP BY s.page, id",
    "covering_tables": f"WITH {_BOXES} SELECT s.page, id, coalesce(min(ref), -1) AS ref FROM s LEFT JOIN b ON b.page = s.page AND l <= x AND x < r AND t <= y AND y < b.b GROUP BY s.page, id",
    "page_envelopes": f"WITH {_BOXES} SELECT page, min(l) AS l, min(t) AS t, max(r) AS r, max(b.b) AS b FROM b GROUP BY page",
}
