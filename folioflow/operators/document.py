"""Documents from their elements (sources.elements.SCHEMA): section paths, content items, filters, Markdown, plain text, outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks of headings: the title, and section headers of levels 1 to 9.
RANKS = 10
#: The kinds of content items by label.
KINDS = {"title": "text", "section_header": "text", "text": "text", "list_item": "text", "caption": "text", "code": "code", "formula": "equation", "table": "table", "picture": "image", "page_header": "page_header", "page_footer": "page_footer"}
NOISE = ("page_header", "page_footer", "document_index")


def heading_contexts(elements: DataFrame) -> DataFrame:
    """elements (doc_id, ord, label, level, text, ...) with headings: those that an element stands under, itself included.

    A heading closes those of its own and of lower rank. One sort of each document; the last heading of each rank
    counts if none of a higher rank came later. Headings without text count as headings with an empty name.
    """
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.when(F.col("label") == "title", 0).when(F.col("label") == "section_header", F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(RANKS - 1)))
    named = F.struct("ord", F.coalesce("text", F.lit("")).alias("text"))
    last = [F.last(F.when(rank == k, named), ignorenulls=True).over(before) for k in range(RANKS)]
    marked = elements.withColumn("_last", F.array(*last))
    above = lambda k: F.array_max(F.transform(F.slice(F.col("_last"), 1, k), lambda x: x["ord"]))
    open_now = F.filter("_last", lambda x, k: x.isNotNull() & (x["ord"] > F.coalesce(F.when(k > 0, above(k)), F.lit(-(2**62)))))
    return marked.withColumn("headings", F.transform(open_now, lambda x: x["text"])).drop("_last")


def section_paths(elements: DataFrame) -> DataFrame:
    """elements with section_path, by place in the stack: a heading of depth d cuts the path to d - 1 names and is added.

    A title has depth 1, a section header its level plus one, at least 2. After a jump of levels a path may so keep a
    deeper heading before a higher one. Paths have RANKS names at most; only a document's headings meet in one row.
    """
    is_heading = F.coalesce("label", F.lit("")).isin("title", "section_header")
    level = F.least(F.greatest(F.coalesce("level", F.lit(1)), F.lit(1)), F.lit(RANKS - 1))
    depth = F.when(F.col("label") == "title", 1).otherwise(level + 1)
    heads = elements.where(is_heading).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ord").alias("at"), depth.cast("int").alias("depth"), F.coalesce("text", F.lit("")).alias("text")))).alias("h"))
    start = F.array().cast("array<struct<at:bigint,path:array<string>>>")

    def step(done, x):
        path = F.coalesce(F.get(done, F.size(done) - 1)["path"], F.array().cast("array<string>"))
        return F.concat(done, F.array(F.struct(x["at"].cast("long").alias("at"), F.concat(F.slice(path, F.lit(1), x["depth"] - 1), F.array(x["text"])).alias("path"))))

    paths = heads.select("doc_id", F.inline(F.aggregate("h", start, step)).alias("_at", "section_path"))
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = elements.withColumn("_at", F.last(F.when(is_heading, F.col("ord").cast("long")), ignorenulls=True).over(before))
    return marked.join(paths, ["doc_id", "_at"], "left").withColumn("section_path", F.coalesce("section_path", F.array().cast("array<string>"))).drop("_at")


def content_items(elements: DataFrame) -> DataFrame:
    """(doc_id, order_index, type, text, text_level, section_path) of elements that say something; of furniture only page headers and footers."""
    kinds = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    found = section_paths(elements).where("trim(coalesce(text, '')) != ''").where("coalesce(layer, 'body') = 'body' OR label IN ('page_header', 'page_footer')")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    level = F.when(F.col("label") == "title", 1).when(F.col("label") == "section_header", F.col("level") + 1)
    return found.select("doc_id", number.cast("long").alias("order_index"), F.coalesce(kinds[F.col("label")], F.lit("text")).alias("type"), "text", level.cast("long").alias("text_level"), "section_path")


def in_section(items: DataFrame, section: str = "", sheet: str = "") -> DataFrame:
    """items some part of whose path holds section, and the first part of which holds sheet; an empty string asks for nothing."""
    if sheet:
        items = items.where(F.coalesce(F.contains(F.get("section_path", F.lit(0)), F.lit(sheet)), F.lit(False)))
    return items.where(F.exists("section_path", lambda p: F.contains(p, F.lit(section)))) if section else items


def in_layers(elements: DataFrame, layers: str = "") -> DataFrame:
    """elements of a comma-separated list of layers, of the body if it names none; no layer means body."""
    known = ("body", "furniture", "background", "invisible", "notes")
    wanted = [x for x in (s.strip().lower() for s in layers.split(",")) if x in known] or ["body"]
    return elements.where(F.coalesce("layer", F.lit("body")).isin(*wanted))


def without_noise(elements: DataFrame, labels: tuple[str, ...] = NOISE) -> DataFrame:
    return elements.where(~F.coalesce("label", F.lit("")).isin(*labels)) if labels else elements


def _markdown(label: Column) -> Column:
    text = F.coalesce("text", F.lit(""))
    level = F.coalesce("level", F.lit(0))
    hashes = F.repeat(F.lit("#"), F.least(F.when(level <= 0, F.coalesce("depth", F.lit(0)) + 1).otherwise(level), F.lit(6)))
    marker = F.when(F.coalesce("marker", F.lit("")) == "", "-").otherwise(F.col("marker"))
    return (
        F.when(label == "title", F.concat(F.lit("# "), text))
        .when(label == "section_header", F.concat(hashes, F.lit(" "), text))
        .when(label == "list_item", F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), marker, F.lit(" "), text))
        .when(label == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), text, F.lit("\n```")))
        .when(label == "formula", F.concat(F.lit("$$\n"), text, F.lit("\n$$")))
        .otherwise(text)
    )


def to_markdown(elements: DataFrame) -> DataFrame:
    """(doc_id, markdown): the body's elements and then the furniture's, neighbouring list items on lines of their own, all else with a blank line between."""
    said = elements.where("trim(coalesce(text, '')) != ''").withColumn("_md", _markdown(F.col("label")))
    part = F.struct(F.when(F.coalesce("layer", F.lit("body")) == "body", 0).otherwise(1).alias("after"), "ord", "label", "_md")
    parts = said.groupBy("doc_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    both = lambda x, k: (x["label"] == "list_item") & (F.element_at("p", F.greatest(k, F.lit(1)))["label"] == "list_item")
    joined = F.transform("p", lambda x, k: F.concat(F.when(k == 0, "").when(both(x, k), "\n").otherwise("\n\n"), x["_md"]))
    return parts.select("doc_id", F.concat(F.rtrim(F.array_join(joined, ""), F.lit("\n")), F.lit("\n")).alias("markdown"))


def plain_text(elements: DataFrame) -> DataFrame:
    """(doc_id, text): elements that are not blank, in order, on lines of their own."""
    parts = elements.where("trim(coalesce(text, '')) != ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return parts.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))


def outline(items: DataFrame) -> DataFrame:
    """(doc_id, n_items, n_headings, n_tables, n_images, groups): counts of content items, and the first parts of their paths as they first occur."""
    count = lambda test: F.count(F.when(test, 1)).alias
    counts = items.groupBy("doc_id").agg(F.count("*").alias("n_items"), count(F.col("text_level").isNotNull())("n_headings"), count(F.col("type") == "table")("n_tables"), count(F.col("type") == "image")("n_images"))
    first = items.where("size(section_path) > 0").groupBy("doc_id", F.get("section_path", F.lit(0)).alias("g")).agg(F.min("order_index").alias("at"))
    groups = first.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "g"))), lambda x: x["g"]).alias("groups"))
    return counts.join(groups, "doc_id", "left").withColumn("groups", F.coalesce("groups", F.array().cast("array<string>")))
