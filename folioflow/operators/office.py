"""Parts of office documents: relationships, sheets, placeholders, comments, tables, charts and paragraphs. All joins are by document and key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.office import part_path
from folioflow.functions.text import is_blank


def related_parts(parts: DataFrame, rels: DataFrame, kind: str) -> DataFrame:
    """parts (doc_id, folder, rid, ...) with path: that of the relationship (doc_id, rid, type, target) of their id whose type ends in kind."""
    fits = rels.where(F.col("type").endswith("/" + kind)).select("doc_id", "rid", "target")
    return parts.join(fits, ["doc_id", "rid"], "left").withColumn("path", part_path(F.col("folder"), F.col("target"))).drop("target")


def authored(comments: DataFrame, people: DataFrame) -> DataFrame:
    """comments (doc_id, person_id, ...) with their author; null where nobody has the id."""
    return comments.join(people.select("doc_id", "person_id", "author"), ["doc_id", "person_id"], "left")


def placed(shapes: DataFrame, layouts: Sequence[DataFrame], fill: Sequence[str]) -> DataFrame:
    """shapes (doc_id, idx, type, *fill) whose missing values come from the first layout with a placeholder of the same idx, else of the same type.

    Layouts have the same columns; of several placeholders of one key the first by idx counts.
    """
    for layout in layouts:
        for key in ("idx", "type"):
            firsts = layout.where(F.col(key).isNotNull()).groupBy("doc_id", key).agg(F.min_by(F.struct(*fill), F.struct("idx", *fill)).alias(f"_by_{key}"))
            shapes = shapes.join(firsts, ["doc_id", key], "left")
        found = F.when(F.col("_by_idx").isNotNull(), F.col("_by_idx")).otherwise(F.col("_by_type"))
        shapes = shapes.withColumn("_found", found).withColumns({c: F.coalesce(c, F.col("_found")[c]) for c in fill}).drop("_by_idx", "_by_type", "_found")
    return shapes


def inherited(styles: DataFrame, fill: Sequence[str], most: int = 10) -> DataFrame:
    """styles (doc_id, style, base, *fill) with values that they lack from the nearest base that has them, at most so many bases up."""
    out = styles.withColumn("_next", F.col("base"))
    up = styles.select("doc_id", F.col("style").alias("_next"), F.col("base").alias("_base"), F.struct(*fill).alias("_up"))
    for _ in range(most):
        out = out.join(up, ["doc_id", "_next"], "left").withColumns({c: F.coalesce(c, F.col("_up")[c]) for c in fill}).drop("_next", "_up").withColumnRenamed("_base", "_next")
    return out.drop("_next")


def _half(number: Column, times: Column) -> Column:
    return F.call_function("shiftright", number.cast("long"), times.cast("int"))


def _blocks(low: Column, high: Column) -> Column:
    """[(size, at)] of the fewest blocks [at * 2**size, (at + 1) * 2**size) that make up the cells from low up to high: at most two of a size."""

    def of(size):
        first, end = -_half(-low.cast("long"), size), _half(high, size)  # of the blocks of this size that lie inside
        block = lambda at: F.struct(size.alias("size"), at.alias("at"))
        return F.array(F.when((first < end) & (first % 2 != 0), block(first)), F.when((first < end) & (end % 2 != 0), block(end - 1)))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(high - low, F.lit(1)))).cast("int")), of)), lambda b: b.isNotNull())


def pivot_results(pivots: DataFrame, tables: DataFrame) -> DataFrame:
    """pivots (doc_id, sheet, row, col, ...) with the first table (doc_id, sheet, idx, l, t, r, b: cells, ends left out) of the same sheet over them.

    A table is cut into blocks whose sides are powers of two, and a pivot looks up the block around it of each size that
    its sheet has; so places and blocks meet by equal keys, and the pairs of a sheet are never formed. Sides are shuffled:
    what a small file's tables and blocks take can't be told from its bytes.
    """
    t = tables.groupBy("doc_id", "sheet", "l", "t", "r", "b").agg(F.min("idx").alias("_idx"))
    t = t.select("doc_id", "sheet", "_idx", "l", "r", F.explode(_blocks(F.col("t"), F.col("b"))).alias("_y"))
    t = t.select("doc_id", "sheet", "_idx", "_y", F.explode(_blocks(F.col("l"), F.col("r"))).alias("_x"))
    blocks = t.groupBy("doc_id", "sheet", *(F.col(f"{c}.{f}").alias(f"{c}_{f}") for c in ("_y", "_x") for f in ("size", "at"))).agg(F.min("_idx").alias("_idx"))
    sizes = blocks.groupBy("doc_id", "sheet").agg(F.collect_set(F.struct("_y_size", "_x_size")).alias("_sizes"))
    places = pivots.select("doc_id", "sheet", "row", "col").distinct()
    around = places.join(sizes.hint("merge"), ["doc_id", "sheet"]).select("doc_id", "sheet", "row", "col", F.inline("_sizes"))
    around = around.withColumns({"_y_at": _half(F.col("row"), F.col("_y_size")), "_x_at": _half(F.col("col"), F.col("_x_size"))})
    met = around.join(blocks.hint("merge"), ["doc_id", "sheet", "_y_size", "_y_at", "_x_size", "_x_at"])
    first = met.groupBy("doc_id", "sheet", "row", "col").agg(F.min("_idx").alias("table_idx"))
    return pivots.join(first.hint("merge"), ["doc_id", "sheet", "row", "col"], "left")


def sheet_sizes(boxes: DataFrame) -> DataFrame:
    """(doc_id, page_no, width, height) from boxes (doc_id, page_no, r, b): a sheet is as large as what stands on it."""
    return boxes.groupBy("doc_id", "page_no").agg(F.max("r").alias("width"), F.max("b").alias("height"))


def sheet_order(children: DataFrame) -> DataFrame:
    """children (doc_id, sheet, kind, ord, t, l) with place: from the top, then from the left, tables before pictures, texts and the rest; without a box last."""
    rank = F.when(F.col("kind") == "tables", 0).when(F.col("kind") == "pictures", 1).when(F.col("kind") == "texts", 2).otherwise(3)
    order = Window.partitionBy("doc_id", "sheet").orderBy(F.col("t").isNull(), "t", "l", F.when(F.col("t").isNotNull(), rank), "ord")
    return children.withColumn("place", F.row_number().over(order).cast("long"))


def leading_titles(cells: DataFrame, by: list[str]) -> DataFrame:
    """(*by, title) of tables (r, c, row_span, col_span, text) whose first row is one cell over several columns above a header of two cells or more."""
    solid = ~is_blank(F.coalesce("text", F.lit("")))
    top, head = solid & (F.col("r") == 0), solid & (F.col("r") == 1) & (F.col("col_span") == 1)
    first = F.min(F.when(top, F.struct("c", "row_span", "col_span", "text")))
    t = cells.groupBy(*by).agg(F.count(F.when(top, 1)).alias("_tops"), F.count(F.when(head, 1)).alias("_heads"), first.alias("_first"), F.max(F.col("r") + F.col("row_span")).alias("_rows"), F.max(F.col("c") + F.col("col_span")).alias("_cols"))
    fits = (F.col("_tops") == 1) & (F.col("_heads") >= 2) & (F.col("_first.c") == 0) & (F.col("_first.row_span") == 1) & F.col("_first.col_span").between(2, F.col("_cols")) & (F.col("_rows") >= 2)
    return t.where(fits).select(*by, F.col("_first.text").alias("title"))


def chart_tables(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rows) of chart points (series, idx, category, value): one row an index, one column a series, gaps empty, the smallest of equal places; the category is that of the smallest series."""
    points = points.groupBy(*by, "series", "idx").agg(F.min("category").alias("category"), F.min("value").alias("value"))
    cell = F.struct("series", F.coalesce("value", F.lit("")).alias("value"))
    rows = points.groupBy(*by, "idx").agg(F.min_by("category", "series").alias("category"), F.map_from_entries(F.collect_list(cell)).alias("at"))
    all_ = rows.groupBy(*by).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.map_keys("at"))))).alias("names"), F.array_sort(F.collect_list(F.struct("idx", F.coalesce("category", F.lit("")).alias("category"), F.map_entries("at").alias("at")))).alias("r"))
    value = lambda row, name: F.coalesce(F.try_element_at(F.transform(F.filter(row["at"], lambda e: e["key"] == name), lambda e: e["value"]), F.lit(1)), F.lit(""))
    return all_.select(*by, F.transform("r", lambda row: F.concat(F.array(row["category"]), F.transform("names", lambda name: value(row, name)))).alias("rows"))


def value_ranges(points: DataFrame, by: list[str]) -> DataFrame:
    """(*by, low, high, first): the range of charts' numbers, and the value of the smallest index."""
    return points.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.min_by("value", "idx").alias("first"))


def pivot_properties(pivots: DataFrame, by: list[str], fields: Sequence[str]) -> DataFrame:
    """(*by, ord, name, value): a pivot's fields that say something, as rows of a table of two columns."""
    pairs = F.array(*(F.struct(F.lit(k).cast("long").alias("ord"), F.lit(f).alias("name"), F.col(f).cast("string").alias("value")) for k, f in enumerate(fields)))
    return pivots.select(*by, F.inline(pairs)).where(~is_blank(F.coalesce("value", F.lit(""))))


def merged_code(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, ord, style, text) with runs of code paragraphs as one; blank ones between them belong to the run, those after it don't count."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    blank = is_blank(F.coalesce("text", F.lit("")))
    code = F.col("style") == "code"
    other = (~code & ~blank).cast("long")
    p = paragraphs.withColumn("_code", code & ~blank).withColumn("_run", F.sum(other).over(order))
    p = p.withColumn("_last", F.max(F.when(F.col("_code"), F.col("ord"))).over(Window.partitionBy("doc_id", "_run"))).withColumn("_first", F.min(F.when(F.col("_code"), F.col("ord"))).over(Window.partitionBy("doc_id", "_run")))
    inside = F.col("ord").between(F.col("_first"), F.col("_last"))
    runs = p.where(inside).groupBy("doc_id", "_run").agg(F.min("ord").alias("ord"), F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    merged = runs.select("doc_id", "ord", F.lit("code").alias("style"), F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text"))
    return p.where(~F.coalesce(inside, F.lit(False)) & ~blank).select("doc_id", "ord", "style", "text").unionByName(merged)


def accepted_text(runs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, layer, text) of runs (ord, revision, text): what stands after all changes in the body, what they delete as notes."""
    layer = F.when(F.col("revision") == "deleted", "notes").otherwise("body")
    said = runs.withColumn("layer", layer).groupBy("doc_id", "paragraph", "layer").agg(F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))
    return said.select("doc_id", "paragraph", "layer", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("text")).where("text != ''")


def unstyled_headings(paragraphs: DataFrame, larger: int = 2) -> DataFrame:
    """paragraphs (doc_id, ord, label, bold, size, shaped) with heading: in documents that have none, bold or larger ones in heading shape.

    Larger: by that many half points than the document's most frequent size, the larger of equals.
    """
    sizes = paragraphs.where("size is not null").groupBy("doc_id", "size").agg(F.count("*").alias("n"))
    mode = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", "size")).alias("_mode"))
    has = paragraphs.groupBy("doc_id").agg(F.max(F.col("label").isin("title", "section_header")).alias("_has"))
    p = paragraphs.join(has, "doc_id").join(mode, "doc_id", "left")
    fallback = ~F.coalesce("_has", F.lit(False)) & F.col("shaped") & (F.coalesce("bold", F.lit(False)) | F.coalesce(F.col("size") >= F.col("_mode") + larger, F.lit(False)))
    return p.withColumn("heading", F.coalesce(F.col("label").isin("title", "section_header"), F.lit(False)) | fallback).drop("_has", "_mode")


def missing_levels(elements: DataFrame) -> DataFrame:
    """(doc_id, ord, level) of groups to stand in for levels that a section header leaves out below the heading before it."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    level = F.when(F.col("label") == "title", 0).when(F.col("label") == "section_header", F.col("level"))
    heads = elements.withColumn("_l", level.cast("long")).where("_l is not null").withColumn("_before", F.coalesce(F.lag("_l").over(order), F.lit(0)))
    return heads.where("_l > _before + 1").select("doc_id", "ord", F.explode(F.sequence(F.col("_before") + 1, F.col("_l") - 1)).alias("level"))
