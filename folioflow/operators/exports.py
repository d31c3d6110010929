"""Documents as HTML and JSON from their elements, and content items as simple Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import is_blank

_ESCAPES = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&#34;", "'": "&#39;"})


def _table(text: str) -> str:
    rows = [[c.strip().replace("\\|", "|") for c in line.strip().strip("|").replace("\\|", "\0").split("|")] for line in text.split("\n")]
    cell = lambda tag, c: f"<{tag}>{c.replace(chr(0), '|').translate(_ESCAPES)}</{tag}>"
    row = lambda tag, r: "<tr>" + "".join(cell(tag, c) for c in r) + "</tr>\n"
    return "<table>\n<thead>\n" + row("th", rows[0]) + "</thead>\n<tbody>\n" + "".join(row("td", r) for r in rows[2:]) + "</tbody>\n</table>\n"


def html_of(elements: list[dict]) -> str:
    """A document's elements, in order, as an HTML page; list items nest by their depth."""
    out, lists = [], []

    def close(depth: int) -> None:
        while len(lists) > depth:
            out.append(f"</li>\n</{lists.pop()}>\n")

    for k, e in enumerate(elements):
        text, label = (e["text"] or "").translate(_ESCAPES), e["label"]
        if not text.strip():
            continue
        if label == "list_item":
            depth = min((e["depth"] or 0), len(lists))
            if len(lists) > depth:
                close(depth + 1)
                out.append("</li>\n")
            else:
                same = [x for x in elements[k:] if x["label"] == "list_item"]
                tag = "ol" if (same[0]["marker"] or "")[:1].isdigit() else "ul"
                lists.append(tag)
                out.append(f"\n<{tag}>\n" if depth else f"<{tag}>\n")
            out.append(f"<li>{text}")
            continue
        close(0)
        if label == "title":
            out.append(f"<h1>{text}</h1>\n")
        elif label == "section_header":
            n = min(e["level"] or (e["depth"] or 0) + 1, 6)
            out.append(f"<h{n}>{text}</h{n}>\n")
        elif label == "code":
            language = f' data-lang="{e["language"].translate(_ESCAPES)}"' if e["language"] else ""
            out.append(f"<pre><code{language}>{text}</code></pre>\n")
        elif label == "formula":
            out.append(f'<p><span class="formula">{text}</span></p>\n')
        elif label == "table":
            out.append(_table(e["text"]))
        elif label == "picture":
            out.append(f'<figure>\n<img src="{text}" alt="">\n</figure>\n')
        else:
            out.append(f"<p>{text}</p>\n")
    close(0)
    return "".join(out)


def to_html(elements: DataFrame) -> DataFrame:
    """(doc_id, html): the body's elements and then the furniture's. Lists open and close by what came before, so a document is one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = ["<!DOCTYPE html>\n<html>\n<head><meta charset=\"utf-8\"></head>\n<body>\n" + html_of(row) + "</body>\n</html>\n" for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pages, pa.string())], names=["doc_id", "html"])

    part = F.struct(F.when(F.coalesce("layer", F.lit("body")) == "body", 0).otherwise(1).alias("after"), "ord", "label", "level", "depth", "text", "marker", "language")
    return elements.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(part)).alias("e")).mapInArrow(run, "doc_id long, html string")


def to_json(elements: DataFrame) -> DataFrame:
    """(doc_id, json): each document's elements in order, with all that is known of them and without what is not."""
    fields = [c for c in elements.columns if c != "doc_id"]
    order = ["ord", *(c for c in fields if c != "ord")]
    parts = elements.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias("elements"))
    return parts.select("doc_id", F.to_json(F.struct(F.col("doc_id"), F.col("elements"))).alias("json"))


def items_markdown(items: DataFrame) -> DataFrame:
    """(doc_id, markdown) of content items (order_index, type, text, text_level): a blank line after each, list items (label) apart from the next by a line break."""
    text = F.rtrim(F.coalesce("text", F.lit("")), F.lit("\n"))
    body = F.trim(text)
    level = F.least(F.greatest(F.col("text_level"), F.lit(1)), F.lit(7)).cast("int")
    is_list = F.col("label") == "list_item"
    said = (
        F.when(F.col("type") == "table", text)
        .when(F.col("type") == "image", F.concat(F.lit("![图片]("), body, F.lit(")")))
        .when(F.col("type") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```")))
        .when(F.col("type") == "equation", F.concat(F.lit("$$\n"), body, F.lit("\n$$")))
        .when(F.col("text_level") > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), body))
        .when(is_list, F.concat(F.lit("- "), body))
        .otherwise(text)
    )
    kept = items.where(~is_blank(F.col("text"))).withColumn("_said", said).withColumn("_list", F.coalesce(is_list & ~(F.col("type").isin("table", "image", "code", "equation")) & ~(F.coalesce("text_level", F.lit(0)) > 0), F.lit(False)))
    plain = ~F.col("_list") & (F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) <= 0)
    gap = plain & F.coalesce(F.lag("_list").over(Window.partitionBy("doc_id").orderBy("order_index")), F.lit(False))
    whole = F.concat(F.when(gap, "\n").otherwise(""), F.col("_said"), F.when(F.col("_list"), "\n").otherwise("\n\n"))
    parts = kept.withColumn("_w", whole).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("order_index", F.col("_w").alias("w")))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["w"]), "").alias("markdown"))
