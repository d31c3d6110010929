"""Documents as JSON trees: items by kind, with references to parents and children."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.table import parse_gfm
from folioflow.operators import tree


def _ref(target: Column) -> Column:
    return F.struct(target.alias("$ref"))


def _said(value: Column) -> Column:
    return F.when(value != "", value)


def _cells(text: Column) -> Column:
    """(num_rows, num_cols, table_cells) of a pipe table, the first row as header."""

    def of(rows):
        cell = lambda r, c, t: F.struct(
            t.alias("text"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), r.alias("start_row_offset_idx"), (r + 1).alias("end_row_offset_idx"),
            c.alias("start_col_offset_idx"), (c + 1).alias("end_col_offset_idx"), (r == 0).alias("column_header"), F.lit(False).alias("row_header"),
        )
        cells = F.flatten(F.transform(rows, lambda row, r: F.transform(row, lambda t, c: cell(r, c, t))))
        return F.struct(F.size(rows).alias("num_rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("num_cols"), cells.alias("table_cells"))

    return F.element_at(F.transform(F.array(parse_gfm(text)), of), 1)  # bound, or each use would parse the text anew


def to_tree(elements: DataFrame, schema_name: str = "document", version: str = "1.0") -> DataFrame:
    """(doc_id, json): body and furniture with their children, and the items by kind. What is not known is left out.

    Children are collected per parent and items per document: a document's JSON is one value, so it has to fit in one row.
    """
    n = tree.nodes(elements, "level", "depth", "layer", "marker", "language")
    below = n.groupBy("doc_id", F.col("parent").alias("ref")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "ref"))), lambda x: _ref(x["ref"])).alias("children"))
    none = F.array().cast("array<struct<`$ref`:string>>")
    n = n.join(below, ["doc_id", "ref"], "left").withColumn("children", F.coalesce("children", none))
    text, label = F.coalesce("text", F.lit("")), F.col("label")
    is_text, is_table, is_picture = (F.col("kind") == k for k in ("texts", "tables", "pictures"))
    item = F.struct(
        "idx", F.col("ref").alias("self_ref"), _ref(F.col("parent")).alias("parent"), "children", F.coalesce("layer", F.lit("body")).alias("content_layer"), "label",
        F.when(is_text, text).alias("orig"), F.when(is_text, text).alias("text"), F.when(label == "section_header", F.col("level")).alias("level"), F.when(label == "list_item", _said(F.col("marker"))).alias("marker"),
        F.when(label == "list_item", F.coalesce(F.col("marker").rlike("^[0-9]"), F.lit(False))).alias("enumerated"), F.when(label == "code", _said(F.col("language"))).alias("code_language"),
        F.when(F.col("depth") > 0, F.struct("depth")).alias("meta"), F.when(is_table, _cells(text)).alias("data"), F.when(is_picture & (text != ""), F.struct(text.alias("uri"))).alias("image"),
    )
    docs = n.groupBy("doc_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, item))).alias(kind) for kind in ("texts", "tables", "pictures")))
    for root in ("body", "furniture"):
        docs = docs.join(below.where(F.col("ref") == f"#/{root}").select("doc_id", F.col("children").alias(f"_{root}")), "doc_id", "left")
    roots = [F.struct(F.lit(f"#/{r}").alias("self_ref"), F.coalesce(f"_{r}", none).alias("children"), F.lit(r).alias("content_layer"), F.lit("_root_").alias("name"), F.lit("unspecified").alias("label")).alias(r) for r in ("body", "furniture")]
    bare = [F.transform(k, lambda x: x.dropFields("idx")).alias(k) for k in ("texts", "tables", "pictures")]
    return docs.select("doc_id", F.to_json(F.struct(F.lit(schema_name).alias("schema_name"), F.lit(version).alias("version"), *roots, *bare)).alias("json"))
