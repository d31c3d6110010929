"""Queries over office parts, page layouts and the document tree: the driver's tables stand in for parts, lines and nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.functions import geometry, office as said
from folioflow.operators import office, pdf_pages, tree
from folioflow.operators.tables import LEAST_LINES, MOST_LINES, spread, tasks
from folioflow.plans.document_plans import _orders


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _one_of(key: str, *values: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


def _num(key: str, modulus: int) -> Column:
    return (F.col(key) % modulus).cast("long")


def scalar_forms(spark, sf_dir):
    kind = _one_of("p_partkey", "image", "table", "equation", "text")
    target = _one_of("p_partkey", "../media/i.png", "/x/y.xml", "./z", "../../../up")
    none = F.lit(None).cast("string")
    return _t(spark, sf_dir, "part").select(
        "p_partkey",
        said.code_language(_one_of("p_partkey", "py", " C++ ", "nothing", "SQL", "Js")).alias("language"),
        F.coalesce(said.resolved(_one_of("p_partkey", "Done", " open ", "?", "ON")).cast("string"), F.lit("?")).alias("resolved"),
        said.object_caption(_one_of("p_partkey", " ", "T ", ""), _one_of("p_size", "", " n"), _one_of("p_partkey", "", "prog"), _one_of("p_size", "", "a/b.bin"), _one_of("p_partkey", "OLE", "chart")).alias("caption"),
        said.safe_member(F.concat(_one_of("p_partkey", "a/", "/", "c:", "../", "a\\..\\", ""), "p_brand")).alias("safe"),
        said.part_path(F.lit("ppt/slides"), target).alias("path"),
        F.coalesce(said.parsed_reference(said.reference(kind, F.when(F.col("p_size") > 3, F.col("p_partkey"))))["idx"], F.lit(-1)).alias("idx"),
        said.text_of_box(F.concat(_one_of("p_partkey", "☑ ", "", "☐"), "p_name")).alias("task"),
        F.round(said.printable_share(F.concat("p_name", F.repeat(F.lit("�"), F.col("p_size").cast("int")))), 6).alias("printable"),
        said.fenced_json(F.concat(F.lit("```json\n"), _one_of("p_partkey", '{"a": {}}', "none"), F.lit("\n```"))).alias("json"),
        said.goes_multimodal(kind, _one_of("p_size", "own", "other"), "own").alias("multimodal"),
        said.item_text(kind, F.col("p_name"), F.lit("cap"), none, F.lit("head"), F.lit("body"), F.lit(""), _one_of("p_size", "x^2", "")).alias("item"),
        F.array_join(said.visible_strings(F.array(F.lit(" a"), F.col("p_brand"), F.lit(" "), F.lit("a "))), "|").alias("visible"),
        F.to_json(said.comment_meta({"id": F.col("p_partkey"), "state": _one_of("p_size", "", "x")})).alias("meta"),
        said.flag(F.concat(F.lit('{"flat": '), _one_of("p_partkey", "true", "false", "1"), F.lit("}")), "flat").alias("flat"),
    )


def geometry_forms(spark, sf_dir):
    k, s = F.col("p_partkey").cast("double"), F.col("p_size").cast("double")
    m = F.struct(s.alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), (s + 1).alias("d"), (F.col("p_partkey") % 700).cast("double").alias("e"), F.lit(-20.0).alias("f"))
    n = F.struct(F.lit(0.0).alias("a"), F.lit(2.0).alias("b"), F.lit(-1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(50.0).alias("e"), F.lit(7.0).alias("f"))
    box = geometry.image_box(m, F.lit(600.0), F.lit(800.0))
    both = geometry.matrix_product(m, n)
    media = F.struct(F.lit(0.0).alias("l"), F.lit(800.0).alias("t"), F.lit(600.0).alias("r"), F.lit(0.0).alias("b"))
    crop = F.struct(k.alias("l"), F.lit(900.0).alias("t"), (k + 100).alias("r"), F.lit(10.0).alias("b"))
    shown = geometry.page_box(crop, media)
    return _t(spark, sf_dir, "part").select("p_partkey", both["a"].alias("a"), both["b"].alias("b"), both["e"].alias("e"), both["f"].alias("f"), box["l"].alias("left"), box["t"].alias("top"), geometry.dots_an_inch(F.lit(1000.0), F.lit(500.0), box).alias("dpi"), shown["l"].alias("shown_l"), shown["r"].alias("shown_r"), geometry.user_unit((s - 5) * 2000).alias("unit"), geometry.rotation((F.col("p_size") * 45).cast("long")).alias("rotation"), geometry.finite(F.when(F.col("p_size") == 7, float("nan")).otherwise(k)).alias("finite"), geometry.middle(k, s).alias("middle"))


def related_parts(spark, sf_dir):
    parts = _t(spark, sf_dir, "supplier").select(F.lit(1).alias("doc_id"), F.lit("word").alias("folder"), F.col("s_nationkey").alias("rid"), "s_suppkey")
    rels = _t(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.col("n_nationkey").alias("rid"), F.when(F.col("n_regionkey") % 2 == 0, "http://x/image").otherwise("http://x/styles").alias("type"), F.concat(F.lit("../media/"), "n_name").alias("target"))
    return office.related_parts(parts, rels, "image").select("s_suppkey", "path")


def authored_comments(spark, sf_dir):
    comments = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("doc_id"), F.col("o_custkey").alias("person_id"), "o_orderkey")
    people = _t(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select((F.col("c_custkey") % 50).alias("doc_id"), F.col("c_custkey").alias("person_id"), F.col("c_name").alias("author"))
    return office.authored(comments, people).select("o_orderkey", "author")


def placed_shapes(spark, sf_dir):
    key = F.col("p_partkey")
    shapes = _t(spark, sf_dir, "part").select(_num("p_partkey", 20).alias("doc_id"), F.when(key % 3 > 0, key % 40).alias("idx"), _one_of("p_size", "title", "body", "pic").alias("type"), F.when(key % 2 == 0, key).alias("l"), "p_partkey")
    layout = _t(spark, sf_dir, "customer").select(_num("c_custkey", 20).alias("doc_id"), (F.col("c_custkey") % 30).alias("idx"), _one_of("c_nationkey", "title", "body").alias("type"), (-F.col("c_custkey")).alias("l"))
    return office.placed(shapes, [layout], ["l"]).select("p_partkey", F.coalesce("l", F.lit(0)).alias("l"))


def inherited_styles(spark, sf_dir):
    n = F.col("n_nationkey").cast("long")
    styles = _t(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), n.alias("style"), F.when(n > 0, F.floor(n / 2)).cast("long").alias("base"), F.when(n % 7 == 1, n * 10).alias("size"))
    return office.inherited(styles, ["size"]).select("style", F.coalesce("size", F.lit(-1)).alias("size"))


def pivot_results(spark, sf_dir):
    pivots = spread(_t(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", most=50_000).select(_num("p_partkey", 3).alias("doc_id"), _num("p_size", 5).alias("sheet"), _num("p_partkey", 101).alias("row"), _num("p_partkey", 31).alias("col"), "p_partkey")
    left, top = _num("c_nationkey", 25), _num("c_custkey", 89)
    tables = spread(_t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", most=50_000).select(_num("c_custkey", 3).alias("doc_id"), _num("c_custkey", 5).alias("sheet"), F.col("c_custkey").alias("idx"), left.alias("l"), top.alias("t"), (left + 6).alias("r"), (top + 4).alias("b"))
    return office.pivot_results(pivots, tables).select("p_partkey", F.coalesce("table_idx", F.lit(-1)).alias("table_idx"))


def sheet_sizes(spark, sf_dir):
    boxes = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page_no"), F.col("l_quantity").alias("r"), F.col("l_extendedprice").alias("b"))
    return office.sheet_sizes(boxes)


def sheet_order(spark, sf_dir):
    key = F.col("p_partkey")
    children = _t(spark, sf_dir, "part").select(F.lit(1).alias("doc_id"), F.col("p_size").alias("sheet"), _one_of("p_partkey", "texts", "groups", "tables", "pictures").alias("kind"), key.alias("ord"), F.when(key % 5 > 0, key % 3).alias("t"), F.when(key % 5 > 0, key % 2).alias("l"))
    return office.sheet_order(children).select(F.col("ord").alias("p_partkey"), "place")


def leading_titles(spark, sf_dir):
    n = _t(spark, sf_dir, "nation").withColumn("c", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_name")).cast("long") - 1)
    cells = n.select("n_regionkey", F.lit(1).alias("r"), "c", F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.col("n_name").alias("text"))
    tops = _t(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(0).alias("r"), F.lit(0).cast("long").alias("c"), F.lit(1).alias("row_span"), F.when(F.col("r_regionkey") == 2, 1).otherwise(3).alias("col_span"), F.col("r_name").alias("text"))
    more = _t(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("n_regionkey"), F.lit(0).alias("r"), F.lit(3).cast("long").alias("c"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), F.when(F.col("r_regionkey") == 1, "x").otherwise(" ").alias("text"))
    return office.leading_titles(cells.unionByName(tops).unionByName(more), ["n_regionkey"])


def _points(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return e.select("user_id", F.col("event_type").alias("series"), _num("event_id", 7).alias("idx"), F.concat(F.lit("c"), _num("event_id", 3).cast("string")).alias("category"), F.floor("value").cast("long").cast("string").alias("value"))


def chart_tables(spark, sf_dir):
    return office.chart_tables(_points(spark, sf_dir), ["user_id"]).select("user_id", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "/").alias("rows"))


def value_ranges(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("idx"), "value")
    return office.value_ranges(e, ["user_id"])


def pivot_properties(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_nationkey") > 9, F.col("c_nationkey")).alias("c_nationkey"), F.when(F.col("c_custkey") % 2 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return office.pivot_properties(c, ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


def merged_code(spark, sf_dir):
    o = _orders(spark, sf_dir)
    return office.merged_code(o.select("doc_id", "ord", F.when(F.col("label").isin("code", "list_item"), "code").otherwise("text").alias("style"), F.when(F.col("label") == "section_header", " ").otherwise(F.col("text")).alias("text")))


def accepted_text(spark, sf_dir):
    runs = _t(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("paragraph"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_returnflag") == "R", "deleted").otherwise("inserted").alias("revision"), F.col("l_partkey").cast("string").alias("text"))
    return office.accepted_text(runs).select("paragraph", "layer", "text")


def unstyled_headings(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ord"), F.when(q == 50, "section_header").otherwise("text").alias("label"), (F.col("l_returnflag") == "A").alias("bold"), (q % 5).alias("size"), (F.col("l_linestatus") == "F").alias("shaped"))
    return office.unstyled_headings(p).groupBy("doc_id").agg(F.count(F.when(F.col("heading"), 1)).alias("headings"))


def missing_levels(spark, sf_dir):
    return office.missing_levels(_orders(spark, sf_dir))


def table_runs(spark, sf_dir):
    left = (F.col("l_partkey") % 20).cast("double")
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    k = tasks(rows)
    rows = rows.repartition(k, "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"))
    rows = rows.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("long").alias("ord"), F.array(left, left + 30).alias("lefts"), F.lit(10.0).alias("font"), (-30.0 * F.col("l_linenumber")).alias("min_y"), (-30.0 * F.col("l_linenumber") + 9).alias("max_y"))
    runs = pdf_pages.table_runs(rows, ["page"])
    rest = pdf_pages.other_lines(rows, runs, ["page"], k).select("page", F.lit(-1).cast("long").alias("run"), "ord")
    return runs.unionByName(rest)


def continued_tables(spark, sf_dir):
    page = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    key = F.col("o_orderkey")
    t = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), key.alias("ord"), page.cast("long").alias("page_no"), F.lit(800.0).alias("height"), (key % 3 * 8).cast("double").alias("l"), F.when(key % 4 > 0, 750.0).otherwise(300.0).alias("t"), ((key % 3 * 8) + 500).cast("double").alias("r"), F.when(key % 5 > 0, 100.0).otherwise(600.0).alias("b"), (key % 9 + 2).alias("n_rows"), F.lit(2).alias("n_cols"), F.array(F.lit("A b"), F.when(key % 7 > 0, F.lit("c")).otherwise(F.lit("C "))).alias("header"))
    return pdf_pages.continued_tables(t).select("doc_id", "ord", "chain", "row_from")


def body_blocks(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return pdf_pages.body_blocks(d.select("doc_id", F.col("ord").cast("long").alias("ord"), F.floor(F.col("ord") / 40).cast("long").alias("page_no"), "text", (F.col("ord") % 17 == 16).alias("special")))


def heading_parents(spark, sf_dir):
    o = _orders(spark, sf_dir)
    blocks = o.select("doc_id", "ord", F.when(F.col("label") == "section_header", F.col("level")).alias("level"), F.when(F.col("label") == "code", "furniture").otherwise("body").alias("layer"), (F.col("label") == "list_item").alias("toc"))
    return pdf_pages.heading_parents(blocks).select("doc_id", "ord", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("parent", "toc_group")))


def _images(spark, sf_dir):
    x = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", least=LEAST_LINES, most=MOST_LINES).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_quantity").cast("long").alias("q"))
    return x.select((F.col("l_orderkey") % 9).alias("doc_id"), F.col("l_orderkey").alias("page_no"), F.col("l_linenumber").cast("long").alias("ord"), F.concat(F.lit("i"), (F.col("p") % 2).cast("string")).alias("name"), (F.col("q") * 500 - 500).alias("width"), (F.col("q") * 200).alias("height"))


def safe_images(spark, sf_dir):
    return pdf_pages.safe_images(_images(spark, sf_dir)).select("page_no", "ord")


def matched_images(spark, sf_dir):
    x = _images(spark, sf_dir)
    found = x.where("ord % 2 = 0").select("doc_id", "page_no", F.regexp_replace("name", "i0", "other").alias("name"), "width", "height", (F.col("page_no") * 10 + F.col("ord")).alias("image"))
    return pdf_pages.matched_images(x, found).select("page_no", "ord", F.coalesce("image", F.lit(-1)).alias("image"))


def page_quality(spark, sf_dir):
    key = F.col("doc_id")
    none = F.array().cast("array<double>")
    p = _t(spark, sf_dir, "documents").select(
        "doc_id", F.when(key % 11 == 0, F.lit(" ")).when(key % 13 == 0, F.concat(F.lit("a"), F.repeat(F.lit("�"), 4))).when(key % 5 == 0, F.lit("x = y + z ∑ and ∞ ≤ 9")).otherwise(F.lit("plain words of a page")).alias("text"), (key % 3 * 90).alias("rotation"), (key % 4).alias("table_rows"), (key % 2).alias("tables"),
        F.when(key % 6 == 0, 0.5).otherwise(1.0).alias("column_confidence"), F.when(key % 12 == 0, F.array(F.lit(10.0), F.lit(40.0), F.lit(90.0))).otherwise(none).alias("lefts"), (key % 7 == 0).alias("fallback"), F.lit(0.3).alias("image_share"), (key % 8).alias("large_images"),
    )
    return pdf_pages.page_quality(p).select("doc_id", "score", F.array_join("reasons", ",").alias("reasons"))


def tree_nodes(spark, sf_dir):
    return tree.nodes(_orders(spark, sf_dir).withColumn("layer", F.when(F.col("ord") == 2, "furniture").otherwise("body")).withColumn("label", F.when(F.col("label") == "code", "table").otherwise(F.col("label")))).select("doc_id", "ord", "ref", "parent", "place")


def merged_trees(spark, sf_dir):
    x = spread(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"), "l_orderkey", least=LEAST_LINES, most=MOST_LINES).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    x = x.select((F.col("l_orderkey") % 40).alias("doc_id"), F.col("l_orderkey").alias("part"), F.col("l_linenumber").cast("long").alias("ord"), F.when(F.col("p") % 2 == 0, "texts").otherwise("tables").alias("kind"))
    x = x.withColumn("idx", (F.row_number().over(Window.partitionBy("part", "kind").orderBy("ord")) - 1).cast("long")).withColumn("parent_kind", F.when(F.col("idx") > 0, F.col("kind")).otherwise("body")).withColumn("parent_idx", F.when(F.col("idx") > 0, F.col("idx") - 1))
    return tree.merged(x).select("part", "ord", "kind", "idx", F.coalesce("parent_idx", F.lit(-1)).alias("parent_idx"))


def looked_up_items(spark, sf_dir):
    refs = lambda *values: F.array(*values)
    key = F.col("c_custkey")
    chunks_ = _t(spark, sf_dir, "customer").select(_num("c_custkey", 5).alias("doc_id"), key.alias("chunk_no"), refs(said.reference(F.lit("texts"), F.col("c_nationkey")), F.lit("#/bad"), said.reference(F.lit("texts"), key % 30)).alias("refs"))
    found = _t(spark, sf_dir, "nation").select(F.explode(F.array(*(F.lit(k).cast("long") for k in range(5)))).alias("doc_id"), said.reference(F.lit("texts"), F.col("n_nationkey")).alias("ref"), F.col("n_name").alias("item"))
    return tree.looked_up(chunks_, found).select("chunk_no", F.array_join("items", ",").alias("items"))


def listed_parts(spark, sf_dir):
    entries = _t(spark, sf_dir, "part").select(F.col("p_size").alias("doc_id"), F.col("p_name").alias("path"), F.col("p_partkey").alias("ord"))
    return tree.listed_first(entries, entries.where("ord % 3 = 0").withColumn("ord", -F.col("ord")))


def page_lists(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("string").alias("page_no"))
    return tree.page_lists(p).select("doc_id", F.array_join(F.col("page_nos").cast("array<string>"), ",").alias("page_nos"))


def block_boxes(spark, sf_dir):
    q = F.col("l_quantity")
    x = _t(spark, sf_dir, "lineitem").select(F.lit(1).alias("doc_id"), F.col("l_orderkey").alias("block"), q.alias("min_x"), (q + 7).alias("max_x"), F.col("l_tax").alias("min_y"), F.col("l_extendedprice").alias("max_y"), (q == 13).alias("fallback"), F.col("l_partkey").cast("string").alias("text"))
    return tree.block_boxes(x).drop("doc_id")


QUERIES = {f.__name__: f for f in (scalar_forms, geometry_forms, related_parts, authored_comments, placed_shapes, inherited_styles, pivot_results, sheet_sizes, sheet_order, leading_titles, chart_tables, value_ranges, pivot_properties, merged_code, accepted_text, unstyled_headings, missing_levels, table_runs, continued_tables, body_blocks, heading_parents, safe_images, matched_images, page_quality, tree_nodes, merged_trees, looked_up_items, listed_parts, page_lists, block_boxes)}

_IMAGES = "x AS (SELECT l_orderkey % 9 AS doc_id, l_orderkey AS page_no, CAST(l_linenumber AS BIGINT) AS ord, 'i' || (min(l_partkey) % 2) AS name, CAST(min(l_quantity) AS BIGINT) * 500 - 500 AS width, CAST(min(l_quantity) AS BIGINT) * 200 AS height FROM lineitem GROUP BY l_orderkey, l_linenumber)"
_ORDERS = "o AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS ord, CAST(min(l_quantity) AS BIGINT) AS q, 'Part ' || min(l_partkey) AS text FROM lineitem GROUP BY l_orderkey, l_linenumber), e AS (SELECT doc_id, ord, text, CASE WHEN q % 5 = 0 THEN 'section_header' WHEN q % 17 = 0 THEN 'title' WHEN q % 5 = 1 THEN 'list_item' WHEN q % 5 = 2 THEN 'code' ELSE 'text' END AS label, CASE WHEN q % 5 = 0 THEN q % 3 + 1 ELSE 0 END AS level FROM o)"

SQL = {
    "scalar_forms": r"""WITH p AS (SELECT *, p_partkey % 4 AS k4, p_partkey % 2 AS k2, p_size % 2 AS s2 FROM part), c AS (SELECT *, ['image', 'table', 'equation', 'text'][k4 + 1] AS kind FROM p)
SELECT p_partkey, ['Python', 'C++', 'unknown', 'SQL', 'JavaScript'][p_partkey % 5 + 1] AS language, ['true', 'false', '?', 'true'][k4 + 1] AS resolved,
CASE WHEN p_partkey % 3 = 1 THEN 'T' WHEN s2 = 1 THEN 'n' WHEN k2 = 1 THEN 'prog' ELSE 'embedded_object' END AS caption, p_partkey % 6 IN (0, 5) AS safe,
['ppt/media/i.png', 'x/y.xml', 'ppt/slides/z', 'up'][k4 + 1] AS path, CASE WHEN p_size > 3 THEN p_partkey ELSE -1 END AS idx, p_name AS task,
round(length(replace(p_name, ' ', '')) / (length(replace(p_name, ' ', '')) + p_size), 6) AS printable, CASE WHEN k2 = 0 THEN '{"a": {}}' END AS json, NOT (kind <> 'text' AND s2 = 0) AS multimodal,
CASE kind WHEN 'image' THEN 'cap' || chr(10) || p_name WHEN 'table' THEN 'head' || chr(10) || 'body' WHEN 'equation' THEN CASE WHEN s2 = 0 THEN 'x^2' ELSE p_name END ELSE p_name END AS item, 'a|' || p_brand AS visible,
CASE WHEN s2 = 0 THEN '{"id":"' || p_partkey || '"}' ELSE '{"id":"' || p_partkey || '","state":"x"}' END AS meta, p_partkey % 3 = 0 AS flat FROM c""",
    "geometry_forms": """WITH p AS (SELECT p_partkey, CAST(p_partkey AS DOUBLE) AS k, CAST(p_size AS DOUBLE) AS s, CAST(p_partkey % 700 AS DOUBLE) AS e, p_size FROM part), b AS (SELECT *, least(600.0, e) AS l0, least(600.0, e + s) AS r0, least(800.0, s + 1 - 20) AS t0 FROM p), x AS (SELECT *, r0 > l0 AND t0 > 0 AS has_box, greatest(k, 0.0) AS cl, least(k + 100, 600.0) AS cr FROM b)
SELECT p_partkey, CAST(0 AS DOUBLE) AS a, s * 2 AS b, CAST(20 + 50 AS DOUBLE) AS e, e * 2 + 7 AS f, CASE WHEN has_box THEN CAST(l0 AS DOUBLE) END AS left, CASE WHEN has_box THEN CAST(t0 AS DOUBLE) END AS top, CASE WHEN has_box THEN CAST(least(greatest(round((72000 / (r0 - l0) + 36000 / t0) / 2), 1), 2400) AS BIGINT) ELSE 72 END AS dpi,
CAST(CASE WHEN cr > cl THEN cl ELSE 0 END AS DOUBLE) AS shown_l, CAST(CASE WHEN cr > cl THEN cr ELSE 600 END AS DOUBLE) AS shown_r, CAST(CASE WHEN p_size > 5 AND (p_size - 5) * 2000 <= 75000 THEN (p_size - 5) * 2000 ELSE 1 END AS DOUBLE) AS unit, CAST(CASE WHEN p_size % 2 = 0 THEN p_size * 45 % 360 ELSE 0 END AS BIGINT) AS rotation, p_size <> 7 AS finite, (k + s) / 2 AS middle FROM x""",
    "related_parts": "SELECT s_suppkey, 'media/' || n_name AS path FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey % 2 = 0",
    "authored_comments": "SELECT o_orderkey, c_name AS author FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 > 0",
    "placed_shapes": "WITH y AS (SELECT c_custkey % 20 AS d, c_custkey % 30 AS i, c_nationkey % 2 AS t, -c_custkey AS l FROM customer), p AS (SELECT *, p_partkey % 20 AS d, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 40 END AS i, p_size % 3 AS t FROM part), a AS (SELECT d, i, min(l) AS l FROM y GROUP BY d, i), b AS (SELECT d, t, arg_min(l, i * 10000000 + l) AS l FROM y GROUP BY d, t) SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_partkey ELSE coalesce(a.l, b.l, 0) END AS l FROM p LEFT JOIN a ON a.d = p.d AND a.i = p.i LEFT JOIN b ON b.d = p.d AND b.t = p.t",
    "inherited_styles": "WITH RECURSIVE up AS (SELECT CAST(n_nationkey AS BIGINT) AS style, CAST(n_nationkey AS BIGINT) AS base, 0 AS k FROM nation UNION ALL SELECT style, base // 2, k + 1 FROM up WHERE k < 10 AND base > 0) SELECT style, coalesce(arg_min(base * 10, k) FILTER (base % 7 = 1), -1) AS size FROM up GROUP BY style",
    "pivot_results": "SELECT p_partkey, coalesce(min(c_custkey), -1) AS table_idx FROM part LEFT JOIN customer ON c_custkey % 3 = p_partkey % 3 AND c_custkey % 5 = p_size % 5 AND p_partkey % 31 >= c_nationkey % 25 AND p_partkey % 31 < c_nationkey % 25 + 6 AND p_partkey % 101 >= c_custkey % 89 AND p_partkey % 101 < c_custkey % 89 + 4 GROUP BY p_partkey",
    "sheet_sizes": "SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS page_no, max(l_quantity) AS width, max(l_extendedprice) AS height FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "sheet_order": "SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey % 5 = 0, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 3 END, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 2 END, CASE WHEN p_partkey % 5 > 0 THEN [2, 3, 0, 1][p_partkey % 4 + 1] END, p_partkey) AS place FROM part",
    "leading_titles": "SELECT r_regionkey AS n_regionkey, r_name AS title FROM region WHERE r_regionkey NOT IN (1, 2)",
    "chart_tables": "WITH p AS (SELECT user_id, event_type AS s, event_id % 7 AS i, min('c' || (event_id % 3)) AS c, min(CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)) AS v FROM events GROUP BY ALL), n AS (SELECT DISTINCT user_id, s FROM p), r AS (SELECT user_id, i, arg_min(c, s) AS c FROM p GROUP BY user_id, i), g AS (SELECT r.user_id, r.i, r.c || '|' || string_agg(coalesce(p.v, ''), '|' ORDER BY n.s) AS line FROM r JOIN n ON n.user_id = r.user_id LEFT JOIN p ON p.user_id = r.user_id AND p.i = r.i AND p.s = n.s GROUP BY r.user_id, r.i, r.c) SELECT user_id, string_agg(line, '/' ORDER BY i) AS rows FROM g GROUP BY user_id",
    "value_ranges": "SELECT user_id, min(value) AS low, max(value) AS high, arg_min(value, event_id) AS first FROM events GROUP BY user_id",
    "pivot_properties": "SELECT c_custkey, CAST(0 AS BIGINT) AS ord, 'c_name' AS name, c_name AS value FROM customer UNION ALL SELECT c_custkey, 1, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer WHERE c_nationkey > 9 UNION ALL SELECT c_custkey, 2, 'c_mktsegment', c_mktsegment FROM customer WHERE c_custkey % 2 = 1",
    "merged_code": f"WITH {_ORDERS}, s AS (SELECT *, CASE WHEN label IN ('code', 'list_item') THEN 1 WHEN label = 'section_header' THEN 0 ELSE 2 END AS k FROM e), c AS (SELECT * FROM s WHERE k = 1), f AS (SELECT c.doc_id, c.ord, c.text, CASE WHEN EXISTS (SELECT 1 FROM s t WHERE t.doc_id = c.doc_id AND t.k = 2 AND t.ord < c.ord AND t.ord > p.ord) OR p.ord IS NULL THEN 1 ELSE 0 END AS new, coalesce(p.ord, c.ord) AS prior FROM c LEFT JOIN (SELECT doc_id, ord AS mine, lag(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS ord FROM c) p ON p.doc_id = c.doc_id AND p.mine = c.ord), g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM f), j AS (SELECT doc_id, run, min(ord) AS ord, string_agg(CASE WHEN new = 1 THEN text ELSE repeat(chr(10) || ' ', (SELECT count(*) FROM s t WHERE t.doc_id = g.doc_id AND t.k = 0 AND t.ord > g.prior AND t.ord < g.ord)) || chr(10) || text END, '' ORDER BY ord) AS text FROM g GROUP BY doc_id, run) SELECT doc_id, ord, 'code' AS style, text FROM j UNION ALL SELECT doc_id, ord, 'text', text FROM s WHERE k = 2",
    "accepted_text": "SELECT l_orderkey AS paragraph, CASE WHEN l_returnflag = 'R' THEN 'notes' ELSE 'body' END AS layer, string_agg(CAST(l_partkey AS VARCHAR), '' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS text FROM lineitem GROUP BY ALL",
    "unstyled_headings": "WITH x AS (SELECT l_orderkey AS doc_id, CAST(l_quantity AS BIGINT) AS q, l_returnflag = 'A' AS bold, l_linestatus = 'F' AS shaped FROM lineitem), n AS (SELECT doc_id, q % 5 AS size, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT doc_id, arg_max(size, n * 10 + size) AS mode FROM n GROUP BY doc_id), h AS (SELECT doc_id, bool_or(q = 50) AS has FROM x GROUP BY doc_id) SELECT doc_id, count(*) FILTER (q = 50 OR NOT has AND shaped AND (bold OR q % 5 >= mode + 2)) AS headings FROM x JOIN m USING (doc_id) JOIN h USING (doc_id) GROUP BY doc_id",
    "missing_levels": f"WITH {_ORDERS}, h AS (SELECT doc_id, ord, CASE WHEN label = 'title' THEN 0 ELSE level END AS l FROM e WHERE label IN ('title', 'section_header')), b AS (SELECT *, coalesce(lag(l) OVER (PARTITION BY doc_id ORDER BY ord), 0) AS before FROM h) SELECT doc_id, ord, r.k AS level FROM b, range(1, 4) AS r(k) WHERE r.k > before AND r.k < l",
    "table_runs": "WITH x AS (SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS ord, min(l_partkey) % 20 AS l FROM lineitem GROUP BY l_orderkey, l_linenumber), b AS (SELECT *, CASE WHEN abs(l - lag(l) OVER w) <= 8 AND ord - lag(ord) OVER w = 1 THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY page ORDER BY ord)), g AS (SELECT *, CAST(sum(new) OVER (PARTITION BY page ORDER BY ord) AS BIGINT) AS run FROM b) SELECT page, CASE WHEN count(*) OVER (PARTITION BY page, run) > 1 THEN run ELSE -1 END AS run, ord FROM g",
    "continued_tables": "WITH t AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderkey % 9 + 2 AS n, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders), f AS (SELECT *, CASE WHEN p % 5 > 0 AND k % 4 > 0 AND abs(k % 3 - p % 3) * 8 <= 15 THEN 1 ELSE 0 END AS goes FROM t), c AS (SELECT *, CAST(sum(1 - goes) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS chain FROM f) SELECT doc_id, k AS ord, chain, CAST(sum(n - goes) OVER (PARTITION BY doc_id, chain ORDER BY k) - n + goes AS BIGINT) AS row_from FROM c",
    "heading_parents": f"WITH {_ORDERS}, b AS (SELECT *, CASE WHEN label = 'section_header' THEN level END AS l FROM e), h AS (SELECT doc_id, ord, l FROM b WHERE l IS NOT NULL) SELECT b.doc_id, b.ord, CASE WHEN label <> 'code' THEN coalesce(max(h.ord), -1) ELSE -1 END AS parent, CASE WHEN label = 'list_item' THEN (SELECT count(*) FROM b x WHERE x.doc_id = b.doc_id AND x.ord <= b.ord AND x.label NOT IN ('code', 'list_item')) ELSE -1 END AS toc_group FROM b LEFT JOIN h ON h.doc_id = b.doc_id AND h.ord < b.ord AND h.l < coalesce(b.l, 4) GROUP BY b.doc_id, b.ord, label, b.l",
    "safe_images": f"WITH {_IMAGES}, d AS (SELECT page_no, name, arg_min(width * height, ord) AS n, bool_and(width BETWEEN 1 AND 50000) AS fine FROM x GROUP BY page_no, name), f AS (SELECT page_no FROM d GROUP BY page_no HAVING sum(n) <= 128000000 AND bool_and(fine)) SELECT page_no, ord FROM x WHERE page_no IN (SELECT page_no FROM f)",
    "matched_images": f"WITH {_IMAGES}, r AS (SELECT page_no, CASE WHEN name = 'i0' THEN 'other' ELSE name END AS name, width, height, page_no * 10 + ord AS image FROM x WHERE ord % 2 = 0), o AS (SELECT page_no, min(image) AS image FROM r GROUP BY page_no HAVING count(*) = 1) SELECT x.page_no, x.ord, coalesce((SELECT min(image) FROM r WHERE r.page_no = x.page_no AND r.name = x.name), (SELECT min(image) FROM r WHERE r.page_no = x.page_no AND r.width = x.width AND r.height = x.height), o.image, -1) AS image FROM x LEFT JOIN o ON o.page_no = x.page_no",
    "page_quality": """WITH d AS (SELECT doc_id, doc_id % 11 = 0 AS blank, doc_id % 11 > 0 AND doc_id % 13 = 0 AS bad, doc_id % 11 > 0 AND doc_id % 13 > 0 AND doc_id % 5 = 0 AS formula FROM documents), r AS (SELECT doc_id, u.name, u.loss, u.k FROM d, unnest([{'k': 0, 'name': 'empty_text_layer', 'loss': CASE WHEN blank THEN 1.0 END}, {'k': 1, 'name': 'garbled_text', 'loss': CASE WHEN bad THEN 0.8 END}, {'k': 2, 'name': 'unresolved_table', 'loss': CASE WHEN doc_id % 4 >= 2 AND doc_id % 2 = 0 THEN 0.25 END}, {'k': 3, 'name': 'formula_dense', 'loss': CASE WHEN formula THEN 0.2 END}, {'k': 4, 'name': 'ambiguous_columns', 'loss': CASE WHEN doc_id % 12 = 0 THEN 0.15 END}, {'k': 5, 'name': 'mixed_text_image', 'loss': CASE WHEN NOT blank AND NOT bad AND doc_id % 8 > 0 THEN 0.2 END}, {'k': 6, 'name': 'coordinate_less_text', 'loss': CASE WHEN doc_id % 7 = 0 THEN 0.2 END}, {'k': 7, 'name': 'rotated_page', 'loss': CASE WHEN doc_id % 3 > 0 THEN 0.2 END}]) AS t(u))
SELECT doc_id, CAST(round(greatest(0, 1 - coalesce(sum(loss), 0)), 9) AS DOUBLE) AS score, coalesce(string_agg(name, ',' ORDER BY k) FILTER (loss IS NOT NULL), '') AS reasons FROM r GROUP BY doc_id""",
    "tree_nodes": f"WITH {_ORDERS}, n AS (SELECT doc_id, ord, CASE WHEN label = 'code' THEN 'tables' ELSE 'texts' END AS kind, ord = 2 AS furniture, label IN ('title', 'section_header') AND ord <> 2 AS head FROM e), r AS (SELECT *, '#/' || kind || '/' || (row_number() OVER (PARTITION BY doc_id, kind ORDER BY ord) - 1) AS ref FROM n), p AS (SELECT *, CASE WHEN furniture THEN '#/furniture' WHEN head THEN '#/body' ELSE coalesce(last_value(CASE WHEN head THEN ref END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING), '#/body') END AS parent FROM r) SELECT doc_id, ord, ref, parent, row_number() OVER (PARTITION BY doc_id, parent ORDER BY ord) - 1 AS place FROM p",
    "merged_trees": "WITH x AS (SELECT l_orderkey % 40 AS doc_id, l_orderkey AS part, CAST(l_linenumber AS BIGINT) AS ord, CASE WHEN min(l_partkey) % 2 = 0 THEN 'texts' ELSE 'tables' END AS kind FROM lineitem GROUP BY l_orderkey, l_linenumber), n AS (SELECT *, row_number() OVER (PARTITION BY part, kind ORDER BY ord) - 1 AS i, row_number() OVER (PARTITION BY doc_id, kind ORDER BY part, ord) - 1 AS idx FROM x) SELECT part, ord, kind, idx, CASE WHEN i > 0 THEN idx - 1 ELSE -1 END AS parent_idx FROM n",
    "looked_up_items": "SELECT c_custkey AS chunk_no, concat_ws(',', a.n_name, b.n_name) AS items FROM customer JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_custkey % 30",
    "listed_parts": "WITH f AS (SELECT p_size AS doc_id, p_name AS path, min(p_partkey) AS low, max(p_partkey) FILTER (p_partkey % 3 = 0) AS listed FROM part GROUP BY ALL) SELECT doc_id, path, row_number() OVER (PARTITION BY doc_id ORDER BY listed IS NULL, CASE WHEN listed IS NULL THEN low ELSE -listed END, path) - 1 AS place FROM f",
    "page_lists": "SELECT l_orderkey AS doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS page_nos FROM (SELECT DISTINCT l_orderkey, l_linenumber AS n FROM lineitem) GROUP BY l_orderkey",
    "block_boxes": "SELECT l_orderkey AS block, CASE WHEN bool_or(l_quantity = 13) THEN NULL ELSE min(l_quantity) END AS l, CASE WHEN bool_or(l_quantity = 13) THEN NULL ELSE max(l_extendedprice) END AS t, CASE WHEN bool_or(l_quantity = 13) THEN NULL ELSE max(l_quantity) + 7 END AS r, CASE WHEN bool_or(l_quantity = 13) THEN NULL ELSE min(l_tax) END AS b, CAST(sum(length(CAST(l_partkey AS VARCHAR))) + count(*) - 1 AS BIGINT) AS n_chars FROM lineitem GROUP BY l_orderkey",
}
