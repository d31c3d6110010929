"""Pages as their text layer gives them: quality, tables across lines and pages, body blocks, headings' parents, images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import formula_density, garbage_ratio, is_blank, strip
from folioflow.operators.pages import left_anchors

#: Bytes and characters of a body block, and of tables that go on: share of the page, points, share of the width.
BLOCK, LOW, HIGH, DRIFT, DRIFT_SHARE = 900, 0.3, 0.7, 12.0, 0.03
#: Distances of cells of one column, and of rows of one table, in points and fonts.
ROW_DRIFT, ROW_DRIFT_FONTS, ROW_GAP, ROW_GAP_FONTS = 7.0, 0.8, 36.0, 4.0
#: Why a page's text layer is doubted, and how much each reason takes from its score.
PENALTIES = {"unresolved_table": 0.25, "formula_dense": 0.2, "ambiguous_columns": 0.15, "mixed_text_image": 0.2, "coordinate_less_text": 0.2, "rotated_page": 0.2}
GARBLED, MAX_GARBLED, DENSE, LEAST_TEXT, IMAGE_SHARE, LARGE_SHARE, LARGE_PIXELS = 0.3, 0.8, 0.08, 12, 0.05, 0.25, 4096
#: Images of a page, pixels of all of them, and of one side.
PLACEMENTS, PAGE_PIXELS, SIDE_PIXELS = 256, 128_000_000, 50_000


def page_quality(pages: DataFrame) -> DataFrame:
    """(*pages, score, reasons) from pages (text, rotation, table_rows, tables, column_confidence, lefts, fallback, image_share, large_images).

    lefts are the left edges of a page's lines. A page without text scores 0; the score stays within 0 and 1.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    n, garbage = F.length(strip(text)), garbage_ratio(text)
    enough = n >= LEAST_TEXT
    holds = {
        "unresolved_table": (F.col("table_rows") >= 2) & (F.col("tables") == 0),
        "formula_dense": (formula_density(text) >= DENSE) & enough,
        "ambiguous_columns": (F.col("column_confidence") == 0.5) & (F.size(left_anchors(F.col("lefts"))) >= 3),
        "mixed_text_image": enough & (F.col("large_images") > 0) & (F.col("image_share") >= IMAGE_SHARE),
        "coordinate_less_text": F.col("fallback"),
        "rotated_page": F.col("rotation") != 0,
    }
    first = F.when(n == 0, F.struct(F.lit("empty_text_layer").alias("reason"), F.lit(1.0).alias("loss"))).when(garbage >= GARBLED, F.struct(F.lit("garbled_text").alias("reason"), F.least(F.lit(MAX_GARBLED), garbage).alias("loss")))
    rest = [F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("reason"), F.lit(PENALTIES[k]).alias("loss"))) for k, c in holds.items()]
    marked = pages.withColumn("_r", F.filter(F.array(first, *rest), lambda r: r.isNotNull()))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.aggregate("_r", F.lit(0.0), lambda s, r: s + r["loss"])))
    return marked.withColumn("score", F.round(score, 9)).withColumn("reasons", F.transform("_r", lambda r: r["reason"])).drop("_r")


def large_image(share: Column, pixels: Column, least_share: float = IMAGE_SHARE) -> Column:
    return (share >= least_share) & ((pixels >= LARGE_PIXELS) | (share >= LARGE_SHARE))


def table_runs(rows: DataFrame, by: list[str], least_rows: int = 2, least_cols: int = 2) -> DataFrame:
    """(*by, run, ord) of rows (ord, lefts, font, min_y, max_y) that belong to a table: runs of rows whose cells stand under each other.

    A row goes on with the one before it if it has as many cells, no left edge drifts and the gap between them is small.
    """
    order = Window.partitionBy(*by).orderBy("ord")
    before = lambda c: F.lag(c).over(order)
    font = F.greatest("font", F.col("_font"))
    drift = F.greatest(F.lit(ROW_DRIFT), ROW_DRIFT_FONTS * font)
    r = rows.withColumns({"_lefts": before("lefts"), "_font": before("font"), "_low": before("min_y")})
    fits = (F.size("lefts") == F.size("_lefts")) & F.forall(F.zip_with("lefts", "_lefts", lambda a, b: F.abs(a - b)), lambda d: d <= drift) & (F.col("_low") - F.col("max_y") <= F.greatest(F.lit(ROW_GAP), ROW_GAP_FONTS * font))
    r = r.withColumn("run", F.sum(F.when(F.coalesce(fits, F.lit(False)), 0).otherwise(1)).over(order).cast("long"))
    own = Window.partitionBy(*by, "run")
    r = r.withColumn("_n", F.count("*").over(own))
    return r.where((F.col("_n") >= least_rows) & (F.size("lefts") >= least_cols)).select(*by, "run", "ord")


def other_lines(lines: DataFrame, used: DataFrame, by: list[str], tasks: int | None = None) -> DataFrame:
    """Lines (ord, ...) that no table has taken, looked up in so many tasks if they are given: it should grow with the lines."""
    if tasks:
        lines, used = (df.repartition(tasks, *by, "ord") for df in (lines, used))
    return lines.join(used.select(*by, "ord"), [*by, "ord"], "left_anti")


def continued_tables(tables: DataFrame) -> DataFrame:
    """tables (doc_id, ord, page_no, height, l, t, r, b, n_rows, n_cols, header) with chain and row_from: tables that go on on the next page are one.

    The first ends in the page's bottom share, the second starts in its top share, on the next page, with the same
    header and edges. The repeated header is left out: row_from is where a table's rows start in the whole.
    """
    order = Window.partitionBy("doc_id").orderBy("page_no", "ord")
    before = {c: F.lag(c).over(order) for c in ("page_no", "height", "l", "r", "b", "n_cols", "header")}
    t = tables.withColumns({f"_{c}": v for c, v in before.items()})
    drift = F.greatest(F.lit(DRIFT), DRIFT_SHARE * F.greatest(F.col("r") - F.col("l"), F.col("_r") - F.col("_l")))
    said = lambda h: F.transform(h, lambda x: F.lower(F.regexp_replace(x, r"\s+", "")))
    same = F.forall(said(F.col("header")), lambda x: x != "") & (said(F.col("header")) == said(F.col("_header")))
    goes_on = (F.col("page_no") == F.col("_page_no") + 1) & (F.col("n_cols") >= 2) & (F.col("n_cols") == F.col("_n_cols")) & (F.col("_b") <= LOW * F.col("_height")) & (F.col("t") >= HIGH * F.col("height")) & (F.abs(F.col("l") - F.col("_l")) <= drift) & (F.abs(F.col("r") - F.col("_r")) <= drift) & same
    t = t.withColumn("_on", F.coalesce(goes_on, F.lit(False)))
    t = t.withColumn("chain", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(order).cast("long"))
    rows = F.sum(F.col("n_rows") - F.when(F.col("_on"), 1).otherwise(0)).over(Window.partitionBy("doc_id", "chain").orderBy("page_no", "ord"))
    t = t.withColumn("row_from", (rows - F.col("n_rows") + F.when(F.col("_on"), 1).otherwise(0)).cast("long"))
    return t.drop("_on", *(f"_{c}" for c in before))


def body_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, first, page_no, text, n_lines) of lines (doc_id, ord, page_no, text, special): special lines alone, others together while they fit.

    A block ends at a page's end, at a special line, and where its bytes, the next line's characters and one are more
    than BLOCK. The lines of one page between special ones meet in a row; first is the ord of the first of them.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    part = F.sum(F.when(F.col("special") | F.coalesce(F.lag("special").over(order), F.lit(False)) | F.coalesce(F.lag("page_no").over(order) != F.col("page_no"), F.lit(True)), 1).otherwise(0)).over(order)
    parts = lines.withColumn("_part", part).groupBy("doc_id", "_part", "page_no").agg(F.min("ord").alias("_at"), F.sort_array(F.collect_list(F.struct("ord", F.coalesce("text", F.lit("")).alias("text")))).alias("x"))
    start = F.array().cast("array<struct<text:string,n:bigint>>")

    def step(done, x):
        last = F.get(done, F.size(done) - 1)
        full = F.coalesce((F.octet_length(last["text"]) > 0) & (F.octet_length(last["text"]) + F.length(x["text"]) + 1 > BLOCK), F.lit(True))
        more = F.struct(F.when(F.octet_length(last["text"]) > 0, F.concat(last["text"], F.lit("\n"), x["text"])).otherwise(x["text"]).alias("text"), (last["n"] + 1).cast("long").alias("n"))
        new = F.struct(x["text"].alias("text"), F.lit(1).cast("long").alias("n"))
        return F.when(full, F.concat(done, F.array(new))).otherwise(F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(more)))

    cut = parts.select("doc_id", "_at", "page_no", F.posexplode(F.aggregate("x", start, step)).alias("_k", "_b")).where(~is_blank(F.col("_b.text")))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "_k")) - 1
    return cut.select("doc_id", number.cast("long").alias("block"), F.col("_at").alias("first"), "page_no", strip(F.col("_b.text")).alias("text"), F.col("_b.n").alias("n_lines"))


def heading_parents(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, ord, level, layer, toc) with parent and toc_group: body stands under the deepest open heading of three levels.

    A heading of level k closes those of k and deeper; parent is its ord, null at the top and for furniture. Contents
    lines that follow each other, furniture aside, share a group.
    """
    furniture = F.col("layer") == "furniture"
    b = blocks.withColumn("_l", F.when(~furniture & F.col("level").between(1, 3), F.col("level")))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("_l") == k, F.col("ord")), ignorenulls=True).over(before) for k in (1, 2, 3)]
    b = b.withColumn("_open", F.array(*last))
    deepest = F.array_max(F.slice("_open", F.lit(1), F.coalesce(F.col("_l"), F.lit(4)).cast("int") - 1))  # the last one of a higher rank is always open
    b = b.withColumn("parent", F.when(~furniture, deepest))
    order = Window.partitionBy("doc_id").orderBy("ord")
    breaks = F.sum(F.when(~furniture & ~F.col("toc"), 1).otherwise(0)).over(order)
    return b.withColumn("toc_group", F.when(F.col("toc") & ~furniture, breaks.cast("long"))).drop("_l", "_open")


def safe_images(placements: DataFrame) -> DataFrame:
    """placements (doc_id, page_no, ord, name, width, height) of pages whose images may be read, PLACEMENTS a page at most.

    A page with a side that is none or too long, or with more pixels in its different images than PAGE_PIXELS, is left
    out as a whole.
    """
    first = Window.partitionBy("doc_id", "page_no").orderBy("ord")
    p = placements.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= PLACEMENTS).drop("_k")
    size = F.col("width").cast("long") * F.col("height")
    bad = ~F.col("width").between(1, SIDE_PIXELS) | ~F.col("height").between(1, SIDE_PIXELS)
    one = F.row_number().over(Window.partitionBy("doc_id", "page_no", "name").orderBy(F.asc_nulls_last("ord")))
    page = Window.partitionBy("doc_id", "page_no")
    p = p.withColumn("_own", F.when((one == 1) & F.col("ord").isNotNull(), size)).withColumn("_bad", F.coalesce(bad, F.lit(True)))
    p = p.withColumn("_n", F.sum("_own").over(page)).withColumn("_bad", F.max("_bad").over(page))
    return p.where("doc_id is not null and page_no is not null").where((F.col("_n") <= PAGE_PIXELS) & ~F.col("_bad")).drop("_own", "_n", "_bad")


def matched_images(placements: DataFrame, resources: DataFrame) -> DataFrame:
    """placements (doc_id, page_no, name, width, height, ...) with the image of their name, else of their size, else the page's only one; the first by image of several."""
    page = ["doc_id", "page_no"]
    named = resources.groupBy(*page, "name").agg(F.min("image").alias("_named"))
    sized = resources.groupBy(*page, "width", "height").agg(F.min("image").alias("_sized"))
    only = resources.groupBy(*page).agg(F.min("image").alias("_only"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    met = placements.join(named, [*page, "name"], "left").join(sized, [*page, "width", "height"], "left").join(only, page, "left")
    return met.withColumn("image", F.coalesce("_named", "_sized", "_only")).drop("_named", "_sized", "_only")
