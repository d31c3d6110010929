"""The document tree as rows: nodes (doc_id, kind, idx, parent_kind, parent_idx, ord, ...) under the roots body and furniture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.office import reference


def nodes(elements: DataFrame, *more: str) -> DataFrame:
    """(doc_id, kind, idx, ref, parent, place, ord, label, text, *more) of elements: each kind is numbered by itself, children stand in the order of the elements.

    A heading stands in its layer's root, what follows it under the last heading; list items, captions and cells are texts.
    """
    kind = F.when(F.col("label") == "table", "tables").when(F.col("label") == "picture", "pictures").otherwise("texts")
    order = Window.partitionBy("doc_id").orderBy("ord")
    n = elements.withColumn("kind", kind)
    n = n.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy("ord")) - 1).cast("long")).withColumn("ref", reference(F.col("kind"), F.col("idx")))
    furniture = F.coalesce("layer", F.lit("body")) == "furniture"
    is_head = F.col("label").isin("title", "section_header") & ~furniture
    under = F.last(F.when(is_head, F.col("ref")), ignorenulls=True).over(order)
    parent = F.when(furniture, F.lit("#/furniture")).when(is_head, F.lit("#/body")).otherwise(F.coalesce(under, F.lit("#/body")))
    n = n.withColumn("parent", parent)
    place = F.row_number().over(Window.partitionBy("doc_id", "parent").orderBy("ord")) - 1
    return n.select("doc_id", "kind", "idx", "ref", "parent", place.cast("long").alias("place"), "ord", "label", "text", *more)


def merged(parts: DataFrame) -> DataFrame:
    """One tree of each document from nodes of parts (doc_id, part, kind, idx, parent_kind, parent_idx): numbers move up by those of the parts before.

    Roots have no number and stay. Parts are counted by kind before anything moves, so no document's nodes meet in one row.
    """
    counts = parts.groupBy("doc_id", "part", "kind").agg((F.max("idx") + 1).alias("n"))
    spread = parts.select("doc_id", "part").distinct().join(counts.select("doc_id", "kind").distinct(), "doc_id").join(counts, ["doc_id", "part", "kind"], "left")
    before = Window.partitionBy("doc_id", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = spread.select("doc_id", "part", "kind", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_shift"))
    out = parts.join(shift, ["doc_id", "part", "kind"])
    up = shift.select("doc_id", "part", F.col("kind").alias("parent_kind"), F.col("_shift").alias("_up"))
    out = out.join(up, ["doc_id", "part", "parent_kind"], "left")
    return out.withColumn("idx", F.col("idx") + F.col("_shift")).withColumn("parent_idx", F.col("parent_idx") + F.coalesce("_up", F.lit(0))).drop("_shift", "_up")


def first_visits(refs: DataFrame) -> DataFrame:
    """(doc_id, ref, ord): each node where a walk comes to it first."""
    return refs.groupBy("doc_id", "ref").agg(F.min("ord").alias("ord"))


def looked_up(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, items) of chunks (doc_id, chunk_no, refs): the items (doc_id, ref, item) of their references in order; bad ones are left out."""
    each = chunks.select("doc_id", "chunk_no", F.posexplode("refs").alias("_k", "ref")).join(found.select("doc_id", "ref", "item"), ["doc_id", "ref"])
    got = each.groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("_k", "item"))).alias("x"))
    out = chunks.select("doc_id", "chunk_no").join(got, ["doc_id", "chunk_no"], "left")
    return out.select("doc_id", "chunk_no", F.coalesce(F.transform("x", lambda x: x["item"]), F.array().cast("array<string>")).alias("items"))


def listed_first(entries: DataFrame, listed: DataFrame) -> DataFrame:
    """(doc_id, path, place): files (doc_id, path, ord) of an archive, those of the contents list first and in its order, each once."""
    both = listed.join(entries.select("doc_id", "path").distinct(), ["doc_id", "path"], "left_semi").select("doc_id", "path", F.lit(0).alias("_by"), "ord").unionByName(entries.select("doc_id", "path", F.lit(1).alias("_by"), "ord"))
    first = both.groupBy("doc_id", "path").agg(F.min(F.struct("_by", "ord")).alias("_at"))
    return first.select("doc_id", "path", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_at", "path")) - 1).cast("long").alias("place"))


def page_lists(pages: DataFrame) -> DataFrame:
    """(doc_id, page_nos): page numbers, kept as texts, in the order of numbers."""
    return pages.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.col("page_no").cast("long"))).alias("page_nos"))


def block_boxes(lines: DataFrame) -> DataFrame:
    """(doc_id, block, l, t, r, b, n_chars): the box around a block's lines (doc_id, block, min_x, max_x, min_y, max_y, fallback, text), null if one has no place."""
    box = {"l": F.min("min_x"), "t": F.max("max_y"), "r": F.max("max_x"), "b": F.min("min_y")}
    g = lines.groupBy("doc_id", "block").agg(F.max("fallback").alias("_f"), F.sum(F.length("text")).alias("_n"), F.count("*").alias("_c"), *(v.alias(k) for k, v in box.items()))
    return g.select("doc_id", "block", *(F.when(~F.col("_f"), F.col(k)).alias(k) for k in box), (F.col("_n") + F.col("_c") - 1).alias("n_chars"))
