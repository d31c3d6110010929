"""Checks of what a visual model says of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import collapse_space, garbage_ratio, is_blank, refuses
from folioflow.operators.pages import MAX_RECOGNISED

#: Labels that a model may give, its least confidence, items of a page, levels of headings, sizes of tables.
LABELS = ("title", "section_header", "text", "paragraph", "list_item", "code", "formula", "caption", "footnote", "reference", "table", "picture")
CONFIDENCE, MAX_ITEMS, MAX_LEVEL, MAX_ROWS, MAX_COLS, TURNS = 0.5, 2000, 9, 500, 100, (0, 90, 180, 270)
#: How much of the smaller of two equal items lies in the other, how far a cell may stick out of its table, and the share of garbage.
SAME, EDGE, GARBAGE = 0.9, 1.0, 0.5

CELLS = "array<struct<r0:long,r1:long,c0:long,c1:long,text:string>>"


def _box_fault(l: Column, t: Column, r: Column, b: Column, width: Column, height: Column) -> Column:  # noqa: E741
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = finite(l) & finite(t) & finite(r) & finite(b) & (l >= 0) & (b >= 0) & (r > l) & (t > b) & ((width <= 0) | (r <= width)) & ((height <= 0) | (t <= height))
    return ~F.coalesce(good, F.lit(False))


def _table_fault(rows: Column, cols: Column, turn: Column, cells: Column) -> Column:
    """The first fault of a table: its size, its direction, and number, places and texts of its cells."""
    outside = F.exists(cells, lambda c: (c.r0 < 0) | (c.c0 < 0) | (c.r1 <= c.r0) | (c.c1 <= c.c0) | (c.r1 > rows) | (c.c1 > cols))
    places = F.flatten(F.transform(cells, lambda c: F.flatten(F.transform(F.sequence(c.r0, c.r1 - 1), lambda r: F.transform(F.sequence(c.c0, c.c1 - 1), lambda k: r * cols + k)))))
    return (
        F.when(~F.coalesce(rows.between(1, MAX_ROWS) & cols.between(1, MAX_COLS), F.lit(False)), "table size")
        .when(~F.coalesce(turn.isin(*TURNS), F.lit(False)), "table direction")
        .when(~F.coalesce(F.size(cells).between(1, rows * cols), F.lit(False)), "number of cells")
        .when(outside, "cell outside")
        .when(F.size(places) > F.size(F.array_distinct(places)), "cells overlap")
        .when(F.forall(cells, lambda c: is_blank(c.text)), "empty table")
    )


def page_faults(items: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, fault): why a visual result is not taken, null for a good one.

    items: page, ord, label, text, level, confidence, l, t, r, b, rows, cols, turn, cells (CELLS); pages: page, width, height, with 0 for
    unknown. The first item with a fault names it, of several the first of the checks; then the page's whole text. Of equal
    items one is too many if most of the smaller lies in the other. A page without items, or with too many, has that fault.
    """
    i = items.join(pages.select("page", F.col("width").alias("_w"), F.col("height").alias("_h")), "page")
    table = F.coalesce(F.col("label") == "table", F.lit(False))
    said = F.when(table, F.array_join(F.transform("cells", lambda c: F.coalesce(c.text, F.lit(""))), "\n")).otherwise(F.coalesce("text", F.lit("")))
    i = i.withColumn("_said", said).withColumn("_chars", F.when(table, F.aggregate("cells", F.lit(0), lambda n, c: n + F.length(F.coalesce(c.text, F.lit(""))))).otherwise(F.length("_said")))
    shape = F.when(table, F.to_json(F.struct("rows", "cols", F.transform("cells", lambda c: F.struct(c.r0, c.c0, c.r1, c.c1, collapse_space(c.text)))))).otherwise(collapse_space(F.col("text")))
    i = i.withColumn("_print", F.xxhash64("label", shape)).withColumn("_shape", shape)
    fault = (
        F.when(~F.coalesce(F.col("label").isin(*LABELS) & F.col("confidence").between(0, 1), F.lit(False)), "fields")
        .when(F.col("confidence") < CONFIDENCE, "confidence")
        .when(_box_fault(*(F.col(c) for c in ("l", "t", "r", "b", "_w", "_h"))), "box")
        .when(table, _table_fault(*(F.col(c) for c in ("rows", "cols", "turn", "cells"))))
        .when(is_blank(F.col("text")), "empty text")
        .when((F.col("label") == "section_header") & ~F.coalesce(F.col("level").between(1, MAX_LEVEL), F.lit(False)), "level")
    )
    i = i.withColumn("_fault", fault)
    few = i.withColumn("_of", F.count("*").over(Window.partitionBy("page"))).where(F.col("_of") <= MAX_ITEMS)
    one = few.where("_fault is null").select("page", "_print", "_shape", "label", "ord", "l", "t", "r", "b")
    a, b = one.alias("a"), one.alias("b")
    both = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("page", "_print", "_shape", "label")] + [F.col("a.ord") < F.col("b.ord")])
    side = lambda lo, hi: F.greatest(F.least(F.col(f"a.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"a.{lo}"), F.col(f"b.{lo}")), F.lit(0.0))
    area = lambda x: (F.col(f"{x}.r") - F.col(f"{x}.l")) * (F.col(f"{x}.t") - F.col(f"{x}.b"))
    twice = both.where(side("l", "r") * side("b", "t") >= SAME * F.least(area("a"), area("b"))).select("b.page", "b.ord", F.lit("twice").alias("_twice")).distinct()
    i = i.join(twice, ["page", "ord"], "left").withColumn("_fault", F.coalesce("_fault", "_twice"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "_said"))), lambda x: x["_said"]), "\n")
    p = i.groupBy("page").agg(F.count("*").alias("_n"), F.min_by("_fault", F.when(F.col("_fault").isNotNull(), F.col("ord"))).alias("_first"), F.sum("_chars").alias("_chars"), whole.alias("_whole"))
    p = pages.select("page").join(p, "page", "left")
    fault = F.when(~F.coalesce(F.col("_n").between(1, MAX_ITEMS), F.lit(False)), "number of items").when(F.col("_first").isNotNull(), F.col("_first")).when(F.col("_chars") > MAX_RECOGNISED, "long").when(refuses(F.col("_whole")), "refused").when(garbage_ratio(F.col("_whole")) >= GARBAGE, "garbled")
    return p.select("page", fault.alias("fault"))
