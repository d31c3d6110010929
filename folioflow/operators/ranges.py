"""Formulas of charts as the cells that they name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.table import a1_column
from folioflow.functions.text import strip

#: Fixed value: the most cells that a formula may name.
MAX_POINTS = 100_000

_RANGE = r"(?i)^=?\s*(.+)!\s*\$?([A-Z]{1,3})\$?([0-9]{1,7})\s*(?::\s*\$?([A-Z]{1,3})\$?([0-9]{1,7})\s*)?$"
_COLUMN = r"^=?\s*(?:(.+)!\s*)?([^!$\[\]']+?)\s*\[\s*([^\[\]#,:@]+?)\s*\]$"
_NAME = r"^=?\s*(?:(.+)!\s*)?([^!$\[\]',;():]+?)$"


def _sheet(name: Column) -> Column:
    """A sheet's name without quotes around it and without a workbook before it."""
    bare = F.when(name.rlike("^'.*'$") & (F.length(name) >= 2), F.replace(F.regexp_replace(name, "^'|'$", ""), F.lit("''"), F.lit("'"))).otherwise(name)
    return F.regexp_replace(bare, r"^.*\]", "")


def cell_range(formula: Column) -> Column:
    """(sheet, r0, c0, r1, c1) of Sheet!$A$1:$B$3, 1-based and both ends inside, corners in either order; null for other formulas."""
    text = strip(formula)
    part = lambda k: F.regexp_extract(text, _RANGE, k)
    row = lambda k: F.nullif(part(k), F.lit("")).try_cast("long")
    col = lambda k: F.when(part(k) != "", a1_column(part(k)) + 1)
    (r0, c0), (r1, c1) = (row(3), col(2)), (F.coalesce(row(5), row(3)), F.coalesce(col(4), col(2)))
    sheet = _sheet(strip(part(1)))
    found = F.struct(sheet.alias("sheet"), F.least(r0, r1).alias("r0"), F.least(c0, c1).alias("c0"), F.greatest(r0, r1).alias("r1"), F.greatest(c0, c1).alias("c1"))
    return F.when(text.rlike(_RANGE) & ~part(1).rlike("[,;()]") & (sheet != "") & (F.least(r0, r1) >= 1), found)


def resolved(formulas: DataFrame, names: DataFrame, tables: DataFrame) -> DataFrame:
    """formulas (doc_id, formula_id, formula) with at: the range that each names, null for none.

    A formula is a range, a name (names: doc_id, name, scope, refers_to; the formula's own sheet before the workbook, whose scope is
    null) or Table[Column] (tables: doc_id, sheet, name, r0, c0, r1, c1, columns, header_rows, totals_rows): the column without
    header and totals. Letters' case doesn't matter; of several of one name the smallest target counts.
    """
    key = lambda c: F.lower(strip(c))
    part = lambda form, k: F.regexp_extract(strip(F.col("formula")), form, k)
    f = formulas.withColumn("_range", cell_range(F.col("formula")))
    name = F.when(F.col("_range").isNull() & strip("formula").rlike(_NAME), key(part(_NAME, 2)))
    f = f.withColumn("_name", name).withColumn("_scope", key(_sheet(strip(part(_NAME, 1)))))
    n = names.groupBy("doc_id", key(F.col("name")).alias("_name"), F.coalesce(key(F.col("scope")), F.lit("")).alias("_in")).agg(F.min("refers_to").alias("_to"))
    own = n.where("_in != ''").withColumnsRenamed({"_in": "_scope", "_to": "_own"})
    book = n.where("_in = ''").select("doc_id", "_name", F.col("_to").alias("_book"))
    f = f.join(own, ["doc_id", "_name", "_scope"], "left").join(book, ["doc_id", "_name"], "left")
    column = F.when(F.col("_range").isNull() & strip("formula").rlike(_COLUMN), key(part(_COLUMN, 3)))
    f = f.withColumn("_column", column).withColumn("_table", F.when(column.isNotNull(), key(part(_COLUMN, 2)))).withColumn("_on", key(_sheet(strip(part(_COLUMN, 1)))))
    first = F.min(F.struct("sheet", "r0", "c0", "r1", "c1", "columns", "header_rows", "totals_rows"))
    t = tables.groupBy("doc_id", key(F.col("name")).alias("_table")).agg(first.alias("_t"))
    f = f.join(t, ["doc_id", "_table"], "left")
    place = F.array_position(F.transform("_t.columns", key), F.col("_column"))
    col = F.col("_t.c0") + place - 1
    top, low = F.col("_t.r0") + F.coalesce("_t.header_rows", F.lit(1)), F.col("_t.r1") - F.coalesce("_t.totals_rows", F.lit(0))
    fits = (place > 0) & (col <= F.col("_t.c1")) & (top <= low) & ((F.col("_on") == "") | (F.col("_on") == key(F.col("_t.sheet"))))
    body = F.when(fits, F.struct(F.col("_t.sheet").alias("sheet"), top.cast("long").alias("r0"), col.cast("long").alias("c0"), low.cast("long").alias("r1"), col.cast("long").alias("c1")))
    return f.select(*formulas.columns, F.coalesce("_range", cell_range(F.coalesce("_own", "_book")), body).alias("at"))


def points(ranges: DataFrame, cells: DataFrame, most: int = MAX_POINTS) -> DataFrame:
    """(doc_id, formula_id, idx, value) of ranges (doc_id, formula_id, at), row by row; cells (doc_id, sheet, row, col, value) that aren't there are empty.

    A range of more than most cells names none. Places are made from the range and met by equality, so no cell is held against a range.
    """
    at = F.col("at")
    width, count = at.c1 - at.c0 + 1, (at.c1 - at.c0 + 1) * (at.r1 - at.r0 + 1)
    p = ranges.where(at.isNotNull() & (count <= most)).select("doc_id", "formula_id", at.sheet.alias("sheet"), at.r0.alias("_r"), at.c0.alias("_c"), width.alias("_w"), F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("idx"))
    p = p.select("doc_id", "formula_id", "sheet", "idx", (F.col("_r") + F.expr("idx div _w")).alias("row"), (F.col("_c") + F.expr("idx % _w")).alias("col"))
    return p.join(cells.select("doc_id", "sheet", "row", "col", "value"), ["doc_id", "sheet", "row", "col"], "left").select("doc_id", "formula_id", "idx", F.coalesce("value", F.lit("")).alias("value"))
