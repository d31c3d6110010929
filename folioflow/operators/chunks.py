"""Retrieval chunks of documents, from their elements and from their content items."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import fixed_chunks
from folioflow.operators.document import heading_contexts

#: Code points of a text chunk, and data rows of a table chunk.
MAX_RUNES, MAX_ROWS = 900, 100


def _islands(rows: DataFrame, order: str, joins: Column) -> DataFrame:
    """rows with _island: numbers of the runs of a document's rows in which each one joins the one before it."""
    return rows.withColumn("_island", F.sum(F.when(joins, 0).otherwise(1)).over(Window.partitionBy("doc_id").orderBy(order)))


def hierarchical(elements: DataFrame) -> DataFrame:
    """(doc_id, chunk_no, headings, text, label): each text, table or code of the body is a chunk, neighbouring list items are one.

    Headings are the context of chunks and no chunks themselves; pictures and blank elements give none.
    """
    body = heading_contexts(elements).where("coalesce(layer, 'body') = 'body' AND label NOT IN ('title', 'section_header', 'picture') AND trim(coalesce(text, '')) != ''")
    order = Window.partitionBy("doc_id").orderBy("ord")
    is_list = F.col("label") == "list_item"
    body = body.withColumn("_joins", is_list & F.coalesce(F.lag(is_list).over(order), F.lit(False)) & F.coalesce(F.lag("headings").over(order) == F.col("headings"), F.lit(False)))
    said = F.when(is_list, F.concat(F.repeat(F.lit("  "), F.coalesce("depth", F.lit(0))), F.coalesce(F.nullif("marker", F.lit("")), F.lit("-")), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    runs = _islands(body, "ord", F.col("_joins")).groupBy("doc_id", "_island").agg(F.min_by("headings", "ord").alias("headings"), F.min_by("label", "ord").alias("label"), F.sort_array(F.collect_list(F.struct("ord", said.alias("said")))).alias("p"))
    return runs.select("doc_id", (F.col("_island") - 1).alias("chunk_no"), "headings", F.array_join(F.transform("p", lambda x: x["said"]), "\n").alias("text"), "label")


def _packed(texts: Column, size: int) -> Column:
    """Texts joined by newlines as long as they fit into size code points."""
    start = F.array().cast("array<string>")

    def step(done, t):
        last = F.get(done, F.size(done) - 1)
        fits = F.coalesce(F.length(last) + 1 + F.length(t) <= size, F.lit(False))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(last, F.lit("\n"), t)))).otherwise(F.concat(done, F.array(t)))

    return F.aggregate(texts, start, step)


def table_parts(body: Column, rows: int = MAX_ROWS) -> Column:
    """A pipe table's parts of so many data rows, each with the header's two lines; a smaller table is one part."""
    lines = F.split(body, "\n")
    data = F.slice(lines, F.lit(3), F.greatest(F.size(lines), F.lit(1)))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(data) / rows).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.concat(F.slice(lines, 1, 2), F.slice(data, k * rows + 1, F.lit(rows))), "\n"))
    return F.when(F.size(data) > rows, parts).otherwise(F.array(body))


def content(items: DataFrame, size: int = MAX_RUNES, rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, chunk_no, type, section_path, content) of content items: neighbouring texts of one level and path together, cut to size.

    Texts under no heading are packed as whole texts up to size before they are cut; page headers and footers give none.
    """
    kept = items.where("type NOT IN ('page_header', 'page_footer')")
    order = Window.partitionBy("doc_id").orderBy("order_index")
    key = F.struct("type", "text_level", "section_path")
    kept = kept.withColumn("_joins", (F.col("type") == "text") & F.coalesce(F.lag(key).over(order).eqNullSafe(key), F.lit(False)))
    runs = _islands(kept, "order_index", F.col("_joins")).groupBy("doc_id", "_island").agg(F.first("type").alias("type"), F.min_by("section_path", "order_index").alias("section_path"), F.sort_array(F.collect_list(F.struct("order_index", "text"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    whole = F.when(F.size("section_path") == 0, _packed(texts, size)).otherwise(F.array(F.array_join(texts, "\n")))
    parts = F.when(F.col("type") == "table", table_parts(F.element_at("p", 1)["text"], rows)).when(F.col("type") == "text", F.flatten(F.transform(whole, lambda t: fixed_chunks(t, size)))).otherwise(texts)
    out = runs.select("doc_id", "_island", "type", "section_path", F.posexplode(parts).alias("_k", "content"))
    return out.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("_island", "_k")) - 1).cast("long").alias("chunk_no"), "type", "section_path", "content")


#: Tokens of a budgeted chunk.
MAX_TOKENS = 512
_UNIT = re.compile(r"[^\n。！？；.!?;]*[\n。！？；.!?;]|[^\n。！？；.!?;]+$")


def in_context(headings: list[str], text: str) -> str:
    """A chunk's text as an embedding model gets it: the headings that are not blank and the text on lines of their own."""
    return "\n".join([*filter(None, (h.strip() for h in headings)), *([text] if text else [])])


def _cut(text: str, fits: Callable[[str], bool]) -> list[str]:
    """text in parts that fit: whole sentences and lines as long as they go together, longer ones by their longest fitting prefix, one character at least."""
    if not text or fits(text):
        return [text] if text else []
    parts, held = [], ""
    for unit in _UNIT.findall(text):
        if fits(held + unit):
            held += unit
            continue
        parts.append(held)
        while unit and not fits(unit):
            low, high = 1, len(unit)
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if fits(unit[:middle]) else (low, middle - 1)
            parts.append(unit[:low])
            unit = unit[low:]
        held = unit
    return [p for p in [*parts, held] if p]


def _cut_table(text: str, fits: Callable[[str], bool]) -> list[str] | None:
    """A pipe table's parts of whole rows that fit, each under the header's two lines; what stands before the table goes with the first. None if the header alone is too long."""
    lines = text.split("\n")
    at = next((k for k, x in enumerate(lines) if k and x.strip().startswith("|") and "---" in x), None)
    if at is None:
        return None
    head, before = lines[at - 1 : at + 1], [x for x in ["\n".join(lines[: at - 1])] if x]
    made = lambda first, rows: "\n".join([*(before if first else []), *head, *rows])
    if not fits(made(True, [])) or not fits(made(False, [])):
        return None
    parts, held = [], []
    for row in lines[at + 1 :]:
        if fits(made(not parts, [*held, row])):
            held.append(row)
            continue
        if held:
            parts.append(made(not parts, held))
        held = []
        if fits(made(not parts, [row])):
            held = [row]
        else:
            for piece in _cut(row, lambda p: fits(made(not parts, [p]))):
                parts.append(made(not parts, [piece]))
    return [*parts, made(not parts, held)] if held else parts


def budget(chunks: list[tuple[list[str], str, str]], most: int = MAX_TOKENS, count: Callable[[str], int] = len, merge: bool = True, repeat_header: bool = True) -> list[tuple[list[str], str]]:
    """(headings, text) of a document's chunks (headings, text, label), cut and then joined with their neighbours under the same headings, within most tokens.

    Headings count too; if they leave no room, the chunk goes without them. A count of nothing for a text that is not
    empty means its characters, a negative one none.
    """
    most = most if most > 0 else MAX_TOKENS
    tokens = lambda text: max(n, 0) if (n := count(text)) or not text else len(text)
    cut = []
    for headings, text, label in chunks:
        if tokens(in_context(headings, text)) <= most:
            cut.append((headings, text))
            continue
        if tokens(in_context(headings, "")) >= most:
            headings = []
        fits = lambda t, h=headings: tokens(in_context(h, t)) <= most
        parts = _cut_table(text, fits) if label == "table" and repeat_header else None
        cut += [(headings, p) for p in (parts if parts and len(parts) > 1 else _cut(text, fits))]
    out: list[tuple[list[str], str]] = []
    for headings, text in cut:
        if merge and out and out[-1][0] == headings and tokens(in_context(headings, both := f"{out[-1][1]}\n\n{text}")) <= most:
            out[-1] = (headings, both)
        else:
            out.append((headings, text))
    return out


def budgeted(chunks: DataFrame, most: int = MAX_TOKENS, count: Callable[[str], int] = len, merge: bool = True, repeat_header: bool = True) -> DataFrame:
    """(doc_id, chunk_no, headings, text) of hierarchical chunks, by budget(). count is any tokenizer's, code points by default.

    Each document's chunks meet in one row, as every cut depends on the one before; documents don't meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = budget([(c["headings"] or [], c["text"] or "", c["label"]) for c in row["c"]], most, count, merge, repeat_header)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_id"]] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([h for h, _ in found], pa.list_(pa.string())), pa.array([t for _, t in found], pa.string())], names=["doc_id", "chunk_no", "headings", "text"])

    docs = chunks.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("chunk_no", "headings", "text", "label"))).alias("c"))
    return docs.mapInArrow(run, "doc_id long, chunk_no long, headings array<string>, text string")
