"""Joins of comments, captions and boxes with the elements that they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.operators.tables import durable


def captions(refs: DataFrame, elements: DataFrame) -> DataFrame:
    """(doc_id, ref, caption) from refs (doc_id, ref, pos, target): texts of elements (doc_id, ord, text), in the order of pos, without anything between."""
    met = refs.join(elements.select("doc_id", F.col("ord").alias("target"), "text"), ["doc_id", "target"], "left")
    parts = met.groupBy("doc_id", "ref").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    return parts.select("doc_id", "ref", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("caption"))


def not_captions(elements: DataFrame, refs: DataFrame) -> DataFrame:
    """elements that no ref names as a caption."""
    return elements.join(refs.select("doc_id", F.col("target").alias("ord")), ["doc_id", "ord"], "left_anti")


def reply_roots(comments: DataFrame) -> DataFrame:
    """(doc_id, id, root) of comments (doc_id, id, parent): where a chain of replies starts.

    A missing parent, and a cycle on the way, make a comment its own root. Parents are followed by doubling: each
    round is one join and ends in a durable table, and n rounds see chains of 2**n replies.
    """
    known = comments.select("doc_id", F.col("id").alias("parent")).distinct()
    start = comments.join(known, ["doc_id", "parent"], "left_semi").select("doc_id", "id", "parent")
    at = comments.select("doc_id", "id").join(start, ["doc_id", "id"], "left").select("doc_id", "id", F.coalesce("parent", "id").alias("to"), F.col("parent").isNotNull().alias("open"))
    at, seen = durable(at), 1
    total = at.count()
    while seen <= total and not at.where("open").isEmpty():  # no chain without a cycle is longer than total
        step = at.select("doc_id", F.col("id").alias("to"), F.col("to").alias("next"), F.col("open").alias("more"))
        moved = at.join(step, ["doc_id", "to"])
        at = durable(moved.select("doc_id", "id", F.when(F.col("open"), F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("open") & F.col("more")).alias("open")))
        seen *= 2
    return at.select("doc_id", "id", F.when(F.col("open"), F.col("id")).otherwise(F.col("to")).alias("root"))


def _finite(*names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull() & ~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n).cast("double")) != float("inf"))
    return out


def nearest(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, id, ref) of points (page, id, x, y): the box (page, ref, l, t, r, b) with the nearest centre on the page; ties: the smallest ref.

    Centres lie in square cells, about one a cell at first; a point sees its own cell and those around it. What it finds
    within a cell's width is nearest; the other points go on with cells twice as wide, until cells are as wide as the page.
    Each round is a join on page and cell and ends in a durable table; n boxes take log2(n) / 2 + 2 rounds at most. Boxes with one centre count once. Points and boxes
    without finite numbers, and points of pages without boxes, give no row; points of one id share one.
    """
    boxes = boxes.where(_finite("l", "t", "r", "b")).select("page", "ref", ((F.col("l") + F.col("r")) / 2).alias("cx"), ((F.col("t") + F.col("b")) / 2).alias("cy"))
    centres = boxes.groupBy("page", "cx", "cy").agg(F.min("ref").alias("ref"))
    points = points.where(_finite("x", "y")).select("page", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    spots = centres.select("page", F.col("cx").alias("x"), F.col("cy").alias("y"), F.lit(1).alias("_n")).unionByName(points.select("page", "x", "y", F.lit(0).alias("_n")))
    size = spots.groupBy("page").agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6)).alias("_wide"), F.sum("_n").alias("_n"))
    size = size.where("_n > 0").select("page", (F.col("_wide") / F.sqrt("_n")).alias("_side"))
    centres = durable(centres.join(size, "page"))
    open_ = durable(points.join(size, "page"))
    done, factor = None, 1.0
    cell = lambda c, step=0: F.floor(F.col(c) / (F.col("_side") * factor)) + step
    while not open_.isEmpty():
        around = [F.struct((cell("x") + i).alias("_gx"), (cell("y") + j).alias("_gy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        asked = open_.select("page", "id", "x", "y", F.inline(F.array(*around)))
        met = asked.join(centres.select("page", "cx", "cy", "ref", cell("cx").alias("_gx"), cell("cy").alias("_gy")), ["page", "_gx", "_gy"])
        dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
        best = met.groupBy("page", "id", "x", "y").agg(F.min(F.struct((dx * dx + dy * dy).alias("d"), "ref")).alias("_best"))
        found = durable(open_.join(best, ["page", "id", "x", "y"], "left"))
        settled = F.coalesce(F.sqrt(F.col("_best.d")) <= F.col("_side") * (0.99 * factor), F.lit(False))
        near = found.where(settled).select("page", "id", "_best")
        done = near if done is None else done.unionByName(near)
        open_, factor = found.where(~settled).drop("_best"), factor * 2
    if done is None:
        return centres.join(points.select("page", "id").limit(0), "page").select("page", "id", "ref")
    return done.groupBy("page", "id").agg(F.min("_best").alias("_best")).select("page", "id", F.col("_best.ref").alias("ref"))


def covering(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page, id, ref) of cells (page, id, x, y): the smallest ref of the boxes that hold the cell, null without one."""
    inside = (cells["page"] == boxes["page"]) & (boxes["l"] <= F.col("x")) & (F.col("x") < boxes["r"]) & (boxes["t"] <= F.col("y")) & (F.col("y") < boxes["b"])
    return cells.join(boxes, inside, "left").groupBy(cells["page"], cells["id"]).agg(F.min("ref").alias("ref"))


def envelope(boxes: DataFrame, by: list[str]) -> DataFrame:
    """The union of each group's boxes."""
    return boxes.groupBy(*by).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def looks_like_heading(text: Column) -> Column:
    """Up to 50 code points without a sentence mark, and without a colon at the end."""
    return (F.length(text) <= 50) & ~text.rlike("[。？！；.?!]") & ~text.rlike("[：:]$")
