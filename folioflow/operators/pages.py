"""Pages from their lines, words, pictures and cells: order, coverage, anchors, visual boxes, checks of recognised text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import WHITE, bound, garbage_ratio, has_cjk, is_blank, refuses, strip

#: Pictures a page that a recogniser gets, distance of left edges, and gaps between words of two cells.
PICTURES, ANCHOR, CELL_GAP, CELL_FONTS = 8, 18.0, 10.0, 1.2
#: Lines of a recognised text that repeat too often, and its greatest length.
REPEATS, REPEAT_LINES, MAX_RECOGNISED = 4, 8, 1_000_000


def reading_order(lines: DataFrame, by: list[str]) -> DataFrame:
    """lines (max_y, min_x, ord, ...) with place: from the top down, and from the left in one height."""
    return lines.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("max_y"), "min_x", "ord")).cast("long"))


def shape_rows(shapes: DataFrame, by: list[str], gap: float) -> DataFrame:
    """shapes (top, left, ord, ...) with row and place: a row goes on while each top is within gap of the one before; inside it the left edge counts."""
    down = Window.partitionBy(*by).orderBy("top", "ord")
    apart = F.coalesce((F.col("top") - F.lag("top").over(down) > gap).cast("long"), F.lit(0))
    rows = shapes.withColumn("_apart", apart).withColumn("row", F.sum("_apart").over(down)).drop("_apart")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("row", "left", "ord")).cast("long"))


def largest_pictures(pictures: DataFrame, by: list[str], most: int = PICTURES) -> DataFrame:
    """The pictures (l, t, r, b, ord, ...) of each page that are largest; ties: the higher one, then the earlier one."""
    area = (F.col("r") - F.col("l")) * F.abs(F.col("t") - F.col("b"))
    w = Window.partitionBy(*by).orderBy(area.desc(), F.desc("t"), "ord")
    return pictures.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def cover_titles(lines: DataFrame, most_lines: int = 15, most: int = 40) -> DataFrame:
    """(doc_id, ord) of the first line in the largest font, if it stands on a first page of fewer than most_lines lines and is short."""
    top = lines.groupBy("doc_id").agg(F.max("font").alias("_font"), F.count(F.when(F.col("page_no") == 0, 1)).alias("_lines"), F.min_by("ord", F.struct(-F.col("font"), "page_no", "ord")).alias("ord"), F.min_by("text", F.struct(-F.col("font"), "page_no", "ord")).alias("_text"), F.min_by("page_no", F.struct(-F.col("font"), "page_no", "ord")).alias("_page"))
    return top.where((F.col("_page") == 0) & (F.col("_lines") < most_lines) & (F.length("_text") <= most)).select("doc_id", "ord")


def covered_area(boxes: DataFrame, by: list[str]) -> DataFrame:
    """(*by, area): the exact area of the union of each group's boxes (l, t, r, b).

    Vertical edges cut a group into strips; in each strip the boxes over it are merged by a running maximum. A group is
    one page's pictures, so its strips times boxes stay small, and they are spread over tasks by group and strip.
    """
    b = boxes.where("r > l and t != b").select(*by, "l", "r", F.least("t", "b").alias("low"), F.greatest("t", "b").alias("high"))
    edges = b.select(*by, F.explode(F.array("l", "r")).alias("x")).distinct()
    strips = edges.withColumn("x2", F.lead("x").over(Window.partitionBy(*by).orderBy("x"))).where("x2 is not null")
    inside = strips.join(b, by).where("l <= x and r >= x2")
    order = Window.partitionBy(*by, "x").orderBy("low", "high").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_top", F.max("high").over(order))
    new = F.greatest(F.col("high") - F.greatest(F.col("low"), F.coalesce("_top", "low")), F.lit(0.0))
    return inside.groupBy(*by).agg(F.sum(new * (F.col("x2") - F.col("x"))).alias("area"))


def left_anchors(edges: Column, distance: float = ANCHOR) -> Column:
    """Left edges, in their order, of which each is more than distance away from those before it."""
    start = F.array().cast("array<double>")
    return F.aggregate(edges, start, lambda kept, x: F.when(F.exists(kept, lambda a: F.abs(a - x) <= distance), kept).otherwise(F.concat(kept, F.array(x.cast("double")))))


def nearest_anchor(x: Column, anchors: Column, tolerance: Column) -> Column:
    """0-based place of the closest anchor within tolerance, the first of equals; -1 without one."""
    near = F.array_min(F.transform(anchors, lambda a, k: F.struct(F.abs(a - x).alias("d"), k.alias("k"))))
    return F.when(near["d"] <= tolerance, near["k"]).otherwise(F.lit(-1))


def row_cells(words: DataFrame, by: list[str]) -> DataFrame:
    """(*by, cell, text, min_x, max_x) of words (min_x, max_x, font, text): a gap of CELL_GAP points or CELL_FONTS median fonts starts a cell."""
    font = words.groupBy(*by).agg(F.median("font").alias("_font"))
    before = Window.partitionBy(*by).orderBy("min_x", "max_x").rowsBetween(Window.unboundedPreceding, -1)
    order = Window.partitionBy(*by).orderBy("min_x", "max_x")
    w = words.join(font, by).withColumn("_end", F.max("max_x").over(before))
    wide = F.coalesce((F.col("min_x") - F.col("_end") >= F.greatest(F.lit(CELL_GAP), CELL_FONTS * F.col("_font"))).cast("long"), F.lit(0))
    w = w.withColumn("_wide", wide).withColumn("cell", F.sum("_wide").over(order))
    cells = w.groupBy(*by, "cell").agg(F.sort_array(F.collect_list(F.struct("min_x", "max_x", "text"))).alias("p"), F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"))
    return cells.select(*by, "cell", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"), "min_x", "max_x")


def outside_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines (page, min_x, max_x, min_y, max_y, ...) whose centre lies in no box (page, l, t, r, b) of their page."""
    x, y = (F.col("min_x") + F.col("max_x")) / 2, (F.col("min_y") + F.col("max_y")) / 2
    b = boxes.select(F.col("page").alias("_page"), F.col("l").alias("_l"), F.col("r").alias("_r"), F.least("t", "b").alias("_low"), F.greatest("t", "b").alias("_high"))
    return lines.join(b, (F.col("page") == F.col("_page")) & x.between(F.col("_l"), F.col("_r")) & y.between(F.col("_low"), F.col("_high")), "left_anti")


def page_budget(pages: DataFrame, by: list[str], most: int) -> DataFrame:
    """The first pages (page_no) of each document: all that a limited recogniser may see."""
    return pages.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy("page_no"))).where(F.col("_k") <= most).drop("_k")


def _prints(text: Column) -> Column:
    lines = F.transform(F.split(text, "\n"), lambda x: F.lower(F.trim(F.regexp_replace(x, f"[{WHITE}]+", " "))))
    return F.filter(lines, lambda x: (F.length(x) >= 4) & ~x.rlike(r"^[|\-: \t]*$"))


def repeats_lines(text: Column) -> Column:
    """Whether a line repeats four times in a row, or makes up half of eight lines or more. Short lines and separators don't count."""
    return F.element_at(F.transform(F.array(_prints(text)), _repeats), 1)  # bound, or each line would make all lines anew


def _repeats(lines: Column) -> Column:
    run = F.exists(F.transform(lines, lambda x, k: (k >= REPEATS - 1) & F.forall(F.slice(lines, F.greatest(k - REPEATS + 2, F.lit(1)), F.lit(REPEATS)), lambda y: y == x)), lambda x: x)
    half = F.greatest(F.lit(REPEATS), F.ceil(F.size(lines) / 2).cast("int"))
    often = lambda ordered: F.exists(F.transform(ordered, lambda x, k: F.coalesce(F.get(ordered, k + half - 1) == x, F.lit(False))), lambda x: x)
    return run | ((F.size(lines) >= REPEAT_LINES) & F.element_at(F.transform(F.array(F.sort_array(lines)), often), 1))


def recognised_fault(text: Column) -> Column:
    """Why a recogniser's result is not taken: empty, long, garbled, refused or repeated; null for a good one."""

    def of(body):
        empty = F.coalesce(F.length(body) == 0, F.lit(True))
        return F.when(empty, "empty").when(F.length(body) > MAX_RECOGNISED, "long").when(garbage_ratio(body) >= 0.5, "garbled").when(refuses(body), "refused").when(repeats_lines(body), "repeated")

    return bound(strip(text), of)


def grids(cells: DataFrame, by: list[str]) -> DataFrame:
    """(*by, rows) of cells (idx, r0, r1, c0, c1, text): spans repeat their text, later cells win, holes are empty."""
    spread = cells.select(*by, "idx", "text", F.explode(F.sequence("r0", F.col("r1") - 1)).alias("r"), "c0", "c1").select(*by, "idx", "text", "r", F.explode(F.sequence("c0", F.col("c1") - 1)).alias("c"))
    one = spread.groupBy(*by, "r", "c").agg(F.max_by("text", "idx").alias("text"))
    all_ = one.groupBy(*by).agg(F.max("r").alias("_r"), F.max("c").alias("_c"), F.map_from_entries(F.collect_list(F.struct(F.struct("r", "c").alias("k"), F.coalesce("text", F.lit("")).alias("v")))).alias("m"))
    at = lambda r: F.transform(F.sequence(F.lit(0).cast("long"), F.col("_c").cast("long")), lambda c: F.coalesce(F.try_element_at("m", F.struct(r.alias("r"), c.alias("c"))), F.lit("")))
    return all_.select(*by, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_r").cast("long")), at).alias("rows"))


def grid_places(cells: DataFrame, sizes: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """(*by, r, c, idx, row_span, col_span, text): each place of tables (rows, cols) and the cell (idx, r0, r1, c0, c1, text) that covers it.

    Later cells win; cells beyond the size are cut; a place without a cell has a null idx, spans of one and an empty text.
    Places are looked up in so many tasks, if they are given: it should grow with the cells.
    """
    spread = cells.join(sizes, by).where("c0 < c1").withColumn("r", F.explode(F.when(F.least("r1", "rows") > F.greatest("r0", F.lit(0)), F.sequence(F.greatest("r0", F.lit(0)), F.least("r1", "rows") - 1)).otherwise(F.array().cast("array<bigint>"))))
    spread = spread.withColumn("c", F.explode(F.when(F.least("c1", "cols") > F.greatest("c0", F.lit(0)), F.sequence(F.greatest("c0", F.lit(0)), F.least("c1", "cols") - 1)).otherwise(F.array().cast("array<bigint>"))))
    cell = F.struct("idx", (F.col("r1") - F.col("r0")).alias("row_span"), (F.col("c1") - F.col("c0")).alias("col_span"), F.coalesce("text", F.lit("")).alias("text"))
    covered = spread.groupBy(*by, "r", "c").agg(F.max_by(cell, "idx").alias("_cell"))
    places = sizes.where("rows > 0 and cols > 0").withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1)))
    if tasks:
        places, covered = (df.repartition(tasks, *by, "r", "c") for df in (places, covered))
    one = F.lit(1).cast("long")
    return places.join(covered, [*by, "r", "c"], "left").select(*by, "r", "c", F.col("_cell.idx").alias("idx"), F.coalesce("_cell.row_span", one).alias("row_span"), F.coalesce("_cell.col_span", one).alias("col_span"), F.coalesce("_cell.text", F.lit("")).alias("text"))


def assembled_lines(glyphs: DataFrame, by: list[str], tolerance: float = 2.0) -> DataFrame:
    """(*by, line, text, y, and font if glyphs have one) of glyphs (x, y, w, text): painted twice counts once, heights within tolerance of a line's first are one line.

    A gap of more than 0.3 of the line's widest glyph becomes a space, but for CJK on either side. Heights of one page
    meet in one row; glyphs don't.
    """
    fonts = ["font"] if "font" in glyphs.columns else []
    g = glyphs.where(~is_blank(F.col("text"))).select(*by, "x", "y", "w", "text", *fonts).distinct()
    heights = g.groupBy(*by).agg(F.sort_array(F.collect_set("y"), asc=False).alias("_ys"))
    bases = F.aggregate("_ys", F.array().cast("array<double>"), lambda done, y: F.when(F.coalesce(F.get(done, F.size(done) - 1) - y <= tolerance, F.lit(False)), done).otherwise(F.concat(done, F.array(y.cast("double")))))
    heights = heights.select(*(F.col(c).alias(f"_by_{c}") for c in by), bases.alias("_bases"))
    same = [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by]
    g = g.join(heights, same).drop(*(f"_by_{c}" for c in by))
    g = g.withColumn("line", F.size(F.filter("_bases", lambda b: b >= F.col("y"))).cast("long") - 1)
    own = Window.partitionBy(*by, "line")
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(own.orderBy("x", "y", "text"))
    before = F.lag("text").over(own.orderBy("x", "y", "text"))
    spaced = F.coalesce((gap > 0.3 * F.max("w").over(own)) & ~has_cjk(before) & ~has_cjk(F.col("text")), F.lit(False))
    g = g.withColumn("_said", F.when(spaced, F.concat(F.lit(" "), F.col("text"))).otherwise(F.col("text")))
    lines = g.groupBy(*by, "line").agg(F.sort_array(F.collect_list(F.struct("x", "y", "text", "_said"))).alias("p"), F.max("y").alias("y"), *(F.max(c).alias(c) for c in fonts))
    return lines.select(*by, "line", F.array_join(F.transform("p", lambda x: x["_said"]), "").alias("text"), "y", *fonts)
