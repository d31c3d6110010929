"""Chat formatting: typed content parts become one marked text a conversation, with a loss mask that can be read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of a segment: no row of the operator's output holds more than the turns of one such range.
SEGMENT_TURNS = 64
#: Fixed values of the template.
OPEN, CLOSE = "<turn role=\"", "</turn>\n"
#: Tokens that a part takes once its placeholder is expanded: image tiles, audio frames and document pages.
IMAGE_TILE, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 512

PARTS = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Reversible: afterwards a text holds no < or > and no quote, so it can't hold a control string."""
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(name))
    return text


def unescape(text: Column) -> Column:
    for raw, name in (('"', "&quot;"), (">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        text = F.replace(text, F.lit(name), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A turn of text alone as typed parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages"))).cast(PARTS)


def expanded_tokens(part: Column) -> Column:
    tiles = lambda side: F.ceil(F.coalesce(side, F.lit(0)) / IMAGE_TILE)
    return (
        F.when(part["kind"] == "image", tiles(part["width"]) * tiles(part["height"]))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS_A_SECOND))
        .when(part["kind"] == "document", F.coalesce(part["pages"], F.lit(0)) * TOKENS_A_PAGE)
        .otherwise(F.lit(0))
        .cast("long")
    )


def visit(part: Column, ordinal: Column) -> Column:
    """One part as flat text: a text escaped, anything else a placeholder with its place among the turn's parts."""
    kind = F.coalesce(part["kind"], F.lit("text"))
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<part kind=\""), escape(kind), F.lit("\" n=\""), ordinal.cast("string"), F.lit("\" ref=\""), escape(F.coalesce(part["ref"], F.lit(""))), F.lit("\"/>")))


def _offsets(lengths: Column) -> Column:
    """Where each piece starts; segments are short, so the fold is."""
    zero = F.array(F.lit(0).cast("long"))
    return F.aggregate(lengths, zero, lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))


def format_segments(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, segment, piece, n_turns, formatted, loss_spans, attachments) from rows (conv_id, turn, role, parts).

    Rows stand in the order of turn (null first), then role, text and attachments; a segment holds the turns of one
    range of SEGMENT_TURNS numbers, cut into pieces of as many rows where turn numbers are null or repeat, so no row of
    the result holds more turns. A conversation's segments, and then their pieces, follow each other by number.
    loss_spans are the code points of formatted that hold a loss_role text; attachments are the parts other than text
    with turn, place, ref and the tokens they expand to. A null conv_id is a conversation of its own, null roles and
    parts are empty, an empty table gives no rows, other columns are not read.
    """
    parts = F.coalesce(F.col("parts").cast(PARTS), F.array().cast(PARTS))
    row = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts"))
    row = row.withColumn("head", F.concat(F.lit(OPEN), escape(F.col("role")), F.lit("\">\n")))
    row = row.withColumn("body", F.array_join(F.transform("parts", visit), ""))
    other = F.filter(F.transform("parts", lambda p, k: F.struct(k.alias("n"), p["kind"].alias("kind"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))), lambda a: F.coalesce(a["kind"], F.lit("text")) != "text")
    row = row.withColumn("attachments", other)
    row = row.withColumn("segment", F.coalesce(F.floor(F.col("turn") / SEGMENT_TURNS).cast("long"), F.lit(-(2**53)).cast("long")))
    place = F.row_number().over(Window.partitionBy("conv_id", "segment").orderBy("turn", "role", "head", "body", "attachments"))
    row = row.withColumn("piece", F.floor((place - 1) / SEGMENT_TURNS).cast("int"))
    group = row.groupBy("conv_id", "segment", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "head", "body", "attachments"))).alias("t"))
    group = group.withColumn("text", F.transform("t", lambda r: F.concat(r["head"], r["body"], F.lit(CLOSE))))
    group = group.withColumn("at", _offsets(F.transform("text", lambda x: F.length(x).cast("long"))))
    spans = F.transform("t", lambda r, k: F.when(r["role"] == loss_role, F.struct((F.element_at("at", k + 1) + F.length(r["head"])).alias("start"), (F.element_at("at", k + 1) + F.length(r["head"]) + F.length(r["body"])).alias("end"))))
    found = F.flatten(F.transform("t", lambda r: F.transform(r["attachments"], lambda a: F.struct(r["turn"].alias("turn"), a["n"].alias("n"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return group.select("conv_id", "segment", "piece", F.size("t").cast("long").alias("n_turns"), F.array_join("text", "").alias("formatted"), F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), found.alias("attachments"))


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text, with placeholders left in the texts."""
    pieces = F.filter(F.split(formatted, CLOSE, -1), lambda p: p != "")
    role = lambda p: unescape(F.substr(F.substring_index(p, "\">\n", 1), F.lit(len(OPEN) + 1)))
    text = lambda p: unescape(F.substr(p, F.length(F.substring_index(p, "\">\n", 1)) + 4))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
