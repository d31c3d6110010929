"""Queries over columns of pages, formulas of charts, visual results, LaTeX and counts of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import latex
from folioflow.operators import columns, ranges, statistics, visual
from folioflow.operators.tables import spread


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_order(spark, sf_dir):
    """Three lines a column, given row by row; every third page has a line over both columns, and every third no gutter."""
    c = spread(_t(spark, sf_dir, "customer").select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("page"), (F.col("c_custkey") % 3).alias("k"))
    ords = F.sequence(F.lit(0), F.when(F.col("k") == 1, 6).otherwise(5))
    x = c.select("page", "k", F.explode(ords).alias("ord"))
    over, right = F.col("ord") == 6, F.col("ord") % 2 == 1
    left = F.when(over | ~right, 50).when(F.col("k") == 2, 255).otherwise(300)
    low = F.when(over, 675).otherwise(700 - 50 * F.expr("ord div 2"))
    x = x.select("page", "ord", left.alias("min_x"), F.when(over | right, 500).otherwise(250).alias("max_x"), low.alias("min_y"), (low + 10).alias("max_y"), F.lit(10).alias("font"))
    return columns.by_columns(x, ["page"]).select("page", F.col("ord").cast("long").alias("ord"), "place")


def _formulas(spark, sf_dir):
    p = F.col("c_custkey")
    text = F.element_at(F.array(*map(F.lit, ("'[1]My ''x'''!$B$3:$A$2", "total", "S!Total", "Data[ Balance ]", "S!C9", "Data[#All]", "OFFSET(A1,1)"))), (p % 7 + 1).cast("int"))
    return _t(spark, sf_dir, "customer").select(F.lit(1).alias("doc_id"), p.alias("formula_id"), text.alias("formula"))


def chart_points(spark, sf_dir):
    """Ranges with corners in any order, names of a workbook and of a sheet, a table's column, and formulas that name nothing."""
    names = spark.createDataFrame([(1, "Total", None, "S!$A$1:$B$1"), (1, "TOTAL", "s", "S!$C$1")], "doc_id int, name string, scope string, refers_to string")
    tables = spark.createDataFrame([(1, "S", "data", 1, 1, 6, 3, ["Key", "Name", "balance"], None, 1)], "doc_id int, sheet string, name string, r0 int, c0 int, r1 int, c1 int, columns array<string>, header_rows int, totals_rows int")
    n = _t(spark, sf_dir, "nation").select(F.lit(1).alias("doc_id"), F.when(F.col("n_nationkey") < 20, "S").otherwise("My 'x'").alias("sheet"), (F.col("n_nationkey") % 20 / 3 + 1).cast("int").alias("row"), (F.col("n_nationkey") % 20 % 3 + 1).alias("col"), F.col("n_name").alias("value"))
    return ranges.points(ranges.resolved(_formulas(spark, sf_dir), names, tables), n).select("formula_id", "idx", "value")


def visual_faults(spark, sf_dir):
    """Pages of two items each, of which the order's number spoils the second in one of several ways."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 12).alias("k"), "o_orderpriority")
    bad = lambda n, x, y: F.when((F.col("k") == n) & (F.col("ord") == 1), x).otherwise(y)
    i = o.select("page", "k", "o_orderpriority", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord")).where("k > 0")
    table = F.col("k").isin(7, 8, 9) & (F.col("ord") == 1)
    cell = lambda r0, r1, c0, c1, t: F.struct(*(F.lit(v).cast("long").alias(n) for n, v in (("r0", r0), ("r1", r1), ("c0", c0), ("c1", c1))), F.lit(t).alias("text"))
    i = i.select(
        "page", "ord", F.when(table, "table").otherwise(bad(1, "headline", bad(5, "section_header", F.lit("text")))).alias("label"),
        bad(4, F.lit(" \n"), bad(10, F.lit("I'm sorry"), F.when(F.col("k") == 6, F.concat("o_orderpriority", F.lit(" text"))).otherwise(F.concat("o_orderpriority", F.col("ord").cast("string"))))).alias("text"),
        bad(5, 12, F.lit(1)).alias("level"), bad(2, 0.25, F.lit(0.75)).alias("confidence"), F.lit(10.0).alias("l"), (200.0 - F.when(F.col("k") == 6, 1).otherwise(F.col("ord") * 100)).alias("t"), bad(3, 700.0, F.lit(300.0)).alias("r"),
        F.lit(20.0).alias("b"), F.lit(2).cast("long").alias("rows"), bad(7, 101, F.lit(2)).cast("long").alias("cols"), F.lit(90).alias("turn"),
        F.when(F.col("k") == 8, F.array(cell(0, 2, 0, 1, "a"), cell(1, 2, 0, 2, "b"))).otherwise(F.array(cell(0, 2, 0, 1, "a"), cell(1, 2, 1, 2, "b"))).alias("cells"),
    )
    return visual.page_faults(i, o.select("page", F.lit(600.0).alias("width"), F.lit(800.0).alias("height"))).withColumn("fault", F.coalesce("fault", F.lit("none")))


def latex_forms(spark, sf_dir):
    p = F.col("p_partkey")
    pick = lambda signs: F.element_at(F.array(*map(F.lit, signs)), (p % len(signs) + 1).cast("int"))
    sign, bound = pick(("∑", "∫", "_")), F.when(F.col("p_size") % 2 == 0, "n").otherwise("")
    return _t(spark, sf_dir, "part").select("p_partkey", latex.escape(F.concat("p_name", F.lit("_α≤"), pick(("{", "\\", "x")))).alias("escaped"), F.concat(latex.large_operator(sign), latex.limits(F.lit("k"), bound)).alias("sum"), latex.delimiter(pick(("{", "", "("))).alias("left"), latex.accent(pick(("~", "→", "?"))).alias("accent"))


def document_counts(spark, sf_dir):
    """Lines as elements of five labels, tables among them as large as their number of pieces."""
    li = _t(spark, sf_dir, "lineitem")
    label = F.element_at(F.array(*map(F.lit, ("text", "formula", "table", "picture", "list_item"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    text = F.when(label == "table", F.concat(F.lit("| a | b |\n| --- | --- |"), F.repeat(F.lit("\n| 1 | 2 |"), F.col("l_linenumber")))).when((label == "picture") & (F.col("l_suppkey") % 2 == 0), " ").otherwise(F.concat(F.lit(" "), F.col("l_suppkey").cast("string")))
    return statistics.document_counts(li.select(F.col("l_orderkey").alias("doc_id"), label.alias("label"), text.alias("text")))


def label_counts(spark, sf_dir):
    return statistics.label_counts(_t(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("label")))


QUERIES = {f.__name__: f for f in (column_order, chart_points, visual_faults, latex_forms, document_counts, label_counts)}

SQL = {
    "column_order": """WITH x AS (SELECT c_custkey AS page, [[0, 3, 1, 4, 2, 5], [0, 1, 3, 5, 4, 6, 2], [0, 1, 2, 3, 4, 5]][c_custkey % 3 + 1] AS p FROM customer)
SELECT page, generate_subscripts(p, 1) - 1 AS ord, CAST(unnest(p) AS BIGINT) AS place FROM x""",
    "chart_points": """WITH c AS (SELECT CASE WHEN n_nationkey < 20 THEN 'S' ELSE 'X' END AS sheet, (n_nationkey % 20) // 3 + 1 AS r, n_nationkey % 20 % 3 + 1 AS c, n_name FROM nation),
f AS (SELECT * FROM (VALUES (0, 'X', 2, 1, 3, 2), (1, 'S', 1, 1, 1, 2), (2, 'S', 1, 3, 1, 3), (3, 'S', 2, 3, 5, 3), (4, 'S', 9, 3, 9, 3)) AS t(k, sheet, r0, c0, r1, c1)),
p AS (SELECT k, sheet, r, c, (r - r0) * (c1 - c0 + 1) + c - c0 AS idx FROM f, unnest(range(r0, r1 + 1)) AS a(r), unnest(range(c0, c1 + 1)) AS b(c))
SELECT c_custkey AS formula_id, CAST(idx AS BIGINT) AS idx, coalesce(n_name, '') AS value FROM customer JOIN p ON p.k = c_custkey % 7 LEFT JOIN c ON c.sheet = p.sheet AND c.r = p.r AND c.c = p.c""",
    "visual_faults": "SELECT o_orderkey AS page, ['number of items', 'fields', 'confidence', 'box', 'empty text', 'level', 'twice', 'table size', 'cells overlap', 'none', 'refused', 'none'][o_orderkey % 12 + 1] AS fault FROM orders",
    "latex_forms": r"""SELECT p_partkey, replace(p_name, '#', '\#') || '\_\alpha \leq ' || ['\{', '\backslash{}', 'x'][p_partkey % 3 + 1] AS escaped, ['\sum', '\int', '\_'][p_partkey % 3 + 1] || '_{k}' || CASE WHEN p_size % 2 = 0 THEN '^{n}' ELSE '' END AS sum,
['\{', '.', '('][p_partkey % 3 + 1] AS left, ['\tilde', '\vec', '\hat'][p_partkey % 3 + 1] AS accent FROM part""",
    "document_counts": """WITH x AS (SELECT l_orderkey AS doc_id, l_partkey % 5 AS k, l_suppkey AS s, l_linenumber + 1 AS n FROM lineitem)
SELECT doc_id, count(*) FILTER (k NOT IN (2, 3)) AS texts, count(*) FILTER (k = 2) AS tables, count(*) FILTER (k = 3) AS pictures, count(*) FILTER (k = 3 AND s % 2 = 1) AS pictures_with_data, count(*) FILTER (k = 1) AS formulas,
CAST(coalesce(sum(length(CAST(s AS VARCHAR))) FILTER (k = 1), 0) AS BIGINT) AS formula_chars, CAST(coalesce(max(n) FILTER (k = 2), 0) AS BIGINT) AS rows, CAST(CASE WHEN count(*) FILTER (k = 2) > 0 THEN 2 ELSE 0 END AS BIGINT) AS cols FROM x GROUP BY doc_id""",
    "label_counts": "SELECT user_id AS doc_id, event_type AS label, count(*) AS n FROM events GROUP BY ALL",
}
