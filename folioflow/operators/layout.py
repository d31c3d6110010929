"""Structure of pages from their lines: furniture, tables of contents, heading ranks, shape rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import WHITE

#: Share of pages on which furniture repeats, its zones and its length; the form of contents lines.
PAGE_SHARE, ZONE, MAX_FURNITURE = 0.6, 0.15, 100
TOC_LINE = r"^(.{1,80}?[.．·…]{4,})\s*([0-9]{1,4})\s*$"


def fingerprint(text):
    """A line without white space, full-width ASCII as plain ASCII."""
    wide, plain = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    return F.translate(F.regexp_replace(text, f"[{WHITE}]+", ""), wide, plain)


def _hinted(df: DataFrame, hint: str | None) -> DataFrame:
    return df.hint(hint) if hint else df


def furniture(lines: DataFrame, hint: str | None = None) -> DataFrame:
    """lines (doc_id, page_no, y, text, ...) with a label: page_header, page_footer or null.

    A line of at most 100 characters in the top or bottom 15 % of its page's extent is furniture if its fingerprint
    stands in that zone on at least 60 % of a document's three or more pages. The top zone counts first. hint is that
    of the join with what repeats in documents: "merge" for very many documents.
    """
    page = Window.partitionBy("doc_id", "page_no")
    spread = lines.withColumn("_top", F.max("y").over(page)).withColumn("_low", F.min("y").over(page)).withColumn("_print", fingerprint(F.col("text")))
    height = F.col("_top") - F.col("_low")
    zone = F.when(F.col("y") >= F.col("_top") - ZONE * height, "page_header").when(F.col("y") <= F.col("_low") + ZONE * height, "page_footer")
    spread = spread.withColumn("_zone", F.when((F.length("text") <= MAX_FURNITURE) & (F.col("_print") != ""), zone))
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page_no").alias("_pages"))
    seen = spread.where("_zone is not null").groupBy("doc_id", "_zone", "_print").agg(F.countDistinct("page_no").alias("_on"))
    often = seen.join(_hinted(pages, hint), "doc_id").where((F.col("_pages") >= 3) & (F.col("_on") >= F.ceil(F.col("_pages") * PAGE_SHARE))).select("doc_id", "_zone", "_print", F.col("_zone").alias("label"))
    return spread.join(_hinted(often, hint), ["doc_id", "_zone", "_print"], "left").drop("_top", "_low", "_print", "_zone")


def toc_regions(lines: DataFrame, order: str = "ord", hint: str | None = None) -> DataFrame:
    """lines (doc_id, order, text, ...) with in_toc: between the first and last of three or more contents lines with single other lines between."""
    doc = Window.partitionBy("doc_id").orderBy(order)
    lines = lines.withColumn("_hit", F.col("text").rlike(TOC_LINE)).withColumn("_n", F.row_number().over(doc))
    hits = lines.where("_hit").withColumn("_new", (F.col("_n") - F.lag("_n", 1, -9).over(doc) > 2).cast("int")).withColumn("_run", F.sum("_new").over(doc))
    runs = hits.groupBy("doc_id", "_run").agg(F.min("_n").alias("_from"), F.max("_n").alias("_to"), F.count("*").alias("_k")).where("_k >= 3").drop("_run", "_k")
    runs = runs.withColumnRenamed("doc_id", "_doc")
    out = lines.join(_hinted(runs, hint), (F.col("doc_id") == F.col("_doc")) & F.col("_n").between(F.col("_from"), F.col("_to")), "left")
    return out.withColumn("in_toc", F.col("_from").isNotNull()).drop("_doc", "_from", "_to", "_hit", "_n")


def heading_ranks(lines: DataFrame, by: list[str], size: str) -> DataFrame:
    """lines with level: 1 for a document's largest size, 2 for the next, 3 for all others."""
    return lines.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy(*by).orderBy(F.col(size).desc())), F.lit(3)))


def upper_median(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """The value at place n // 2 of each group's sorted values, not averaged."""
    w = Window.partitionBy(*by)
    ranked = values.withColumn("_k", F.row_number().over(w.orderBy(column))).withColumn("_n", F.count("*").over(w))
    return ranked.where("_k = floor(_n / 2) + 1").select(*by, F.col(column).alias("median"))


def mode(values: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value of each group; ties go to the larger one. Counted per task before the shuffle."""
    counts = values.groupBy(*by, column).count()
    return counts.groupBy(*by).agg(F.max_by(column, F.struct("count", column)).alias("mode"))
