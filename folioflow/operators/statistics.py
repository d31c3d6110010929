"""What documents are made of, in numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.functions.table import size_estimate
from folioflow.functions.text import strip


def document_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, texts, tables, pictures, pictures_with_data, formulas, formula_chars, rows, cols): counts of elements, and the size of the largest table."""
    size = F.when(F.col("label") == "table", size_estimate(F.col("text")))
    is_ = lambda label: F.col("label") == label
    largest = F.max(F.struct(size["n_rows"].alias("n_rows"), size["n_cols"].alias("n_cols")))
    return elements.groupBy("doc_id").agg(
        F.count_if(~F.col("label").isin("table", "picture")).alias("texts"), F.count_if(is_("table")).alias("tables"), F.count_if(is_("picture")).alias("pictures"),
        F.count_if(is_("picture") & (F.coalesce(strip("text"), F.lit("")) != "")).alias("pictures_with_data"), F.count_if(is_("formula")).alias("formulas"),
        F.coalesce(F.sum(F.when(is_("formula"), F.length(strip("text")))), F.lit(0)).cast("long").alias("formula_chars"),
        F.coalesce(largest["n_rows"], F.lit(0)).cast("long").alias("rows"), F.coalesce(largest["n_cols"], F.lit(0)).cast("long").alias("cols"),
    )


def label_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, label, n): a row a document and label; a map of all labels would be one row a document."""
    return elements.groupBy("doc_id", "label").agg(F.count("*").alias("n"))
