"""String functions as columns. White space is one fixed class everywhere: Unicode's White_Space."""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points with the Unicode property White_Space, as a regex class body.
WHITE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WHITE_CHARS = "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def sanitize(text: Column) -> Column:
    """Without C0 control characters other than tab, newline and carriage return."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_CHARS))


def bound(value: Column, say: Callable[[Column], Column]) -> Column:
    """say(value) with value computed once; as a bare column it would be computed for each mention."""
    return F.element_at(F.transform(F.array(value), say), 1)


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{WHITE}]+", " "))


def fixed_chunks(text: Column, size: int) -> Column:
    """Array of consecutive pieces of size code points, cut in one pass; empty for an empty or null text."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0)), F.array().cast("array<string>"))


def garbage_ratio(text: Column) -> Column:
    """Replacement, control and private-use characters for each character that is no white space; 0 for a blank text."""
    solid = F.length(F.translate(text, WHITE_CHARS, ""))
    bad = F.length(F.regexp_replace(text, rf"[^\x{{FFFD}}\p{{Cc}}\p{{Co}}]++|[{WHITE}]++", ""))  # whole runs go, not characters
    return F.when(solid > 0, bad / solid).otherwise(F.lit(0.0))


def semantic_units(text: Column) -> Column:
    """Pieces that end at a newline or a sentence mark; what is left at the end is one too."""
    return F.filter(F.split(text, r"(?<=[\n。！？；.!?;])"), lambda unit: unit != "")


def origin_hash(data: Column) -> Column:
    """The last eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.right(F.sha2(data, 256), F.lit(16)), 16, 10).cast("decimal(20,0)")


def mime_type(name: Column) -> Column:
    """Media type by file extension, application/octet-stream for others."""
    known = F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair))
    return F.coalesce(known[F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1))], F.lit("application/octet-stream"))


#: Registered media types of the formats read.
MIME = {
    ".txt": "text/plain", ".md": "text/markdown", ".html": "text/html", ".htm": "text/html", ".csv": "text/csv", ".eml": "message/rfc822", ".adoc": "text/asciidoc",
    ".pdf": "application/pdf", ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".bmp": "image/bmp", ".webp": "image/webp", ".svg": "image/svg+xml",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", ".epub": "application/epub+zip", ".json": "application/json", ".glb": "model/gltf-binary",
}

#: Ligatures and the soft hyphen of extracted text, and what they stand for.
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "­": ""}
#: Fixed value: what counts as a formula character, as a regex class.
FORMULA = r"[=∑∏√∫≈≠≤≥±×÷∞∂∆∇∈∉⊂⊃∪∩^_{}\[\]\p{Sm}]"
#: Fixed value: code points of CJK blocks, as a regex class body.
CJK = r"\x{2E80}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


def fold_ligatures(text: Column) -> Column:
    for raw, plain in LIGATURES.items():
        text = F.replace(text, F.lit(raw), F.lit(plain))
    return text


def has_cjk(text: Column) -> Column:
    return text.rlike(f"[{CJK}]")


def formula_density(text: Column) -> Column:
    """Formula characters for each character that is no white space; 0 for a blank text."""
    solid = F.length(F.regexp_replace(text, f"[{WHITE}]", ""))
    return F.when(solid > 0, F.regexp_count(text, F.lit(FORMULA)) / solid).otherwise(F.lit(0.0))


def first_line(text: Column, size: int = 80) -> Column:
    """The first line without white space around, cut after size code points and then with an ellipsis."""
    line = strip(F.substring_index(text, "\n", 1))
    return F.when(F.length(line) > size, F.concat(F.substr(line, F.lit(1), F.lit(size)), F.lit("…"))).otherwise(line)


def trim_line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)[ \t]+$", "")


def width_estimate(text: Column) -> Column:
    """Width in ems: wide scripts, from U+2E80 on, take one, all else 0.55; one at least."""
    wide = F.length(F.regexp_replace(text, r"[\x{0}-\x{2E7F}]", ""))
    return F.greatest(F.lit(1.0), wide + 0.55 * (F.length(text) - wide))


def style_heading_level(style: Column) -> Column:
    """The number in a style name like Heading 2, one at least; 0 for other names."""
    number = F.regexp_extract(style, r"(?i)^heading\s*(\d+)$", 1).try_cast("long")
    return F.when(number.isNull(), 0).otherwise(F.greatest(number, F.lit(1))).cast("long")


def chart_number(text: Column) -> Column:
    """The number in a text with thousands commas and maybe one percent sign, which doesn't divide; null if there is none."""
    number = F.regexp_replace(F.trim(F.regexp_replace(text, "[,，]", "")), "%$", "").try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)


def data_uri(data: Column, media_type: Column, limit: int = 8 << 20) -> Column:
    """Binary data as a base64 data URI, empty if longer than limit bytes."""
    body = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return F.when(F.octet_length(data) <= limit, F.concat(F.lit("data:"), media_type, F.lit(";base64,"), body)).otherwise(F.lit(""))


#: Openings with which a recogniser may introduce its result.
PREAMBLES = ("以下是识别结果", "识别结果如下", "OCR 结果如下", "Here is the OCR result")
#: Phrases that mean a recogniser gave up.
REFUSALS = ("抱歉，我无法", "无法识别", "不能识别", "无法提供", "看不清", "没有可识别", "i'm sorry", "i am sorry", "cannot recognize", "can't recognize", "unable to recognize")


def clean_recognised(text: Column) -> Column:
    """A recogniser's result without the bare or Markdown fence around it and without its opening phrase."""
    inner = strip(F.regexp_replace(strip(text), r"(?is)^```(?:markdown|md)?[ \t\r\n]*(.*?)\n?```$", "$1"))
    return strip(F.regexp_replace(inner, r"^(?iu:" + "|".join(PREAMBLES) + r")[ \t]*[：:]*[ \t]*", ""))


def refuses(text: Column) -> Column:
    return bound(F.lower(text), lambda said: functools.reduce(operator.or_, (F.contains(said, F.lit(phrase)) for phrase in REFUSALS), F.lit(False)))


def plausible_heading(text: Column, most: int = 80) -> Column:
    """Up to most code points, no garbage, no single character but CJK; Latin text must not be mostly letters apart."""
    body = strip(text)
    n = F.length(body)
    letters = F.transform(F.filter(F.split(body, f"[{WHITE}]+"), lambda w: w != ""), lambda w: F.regexp_count(w, F.lit(r"\p{IsLatin}")))
    other = body.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    spaced = (F.size(F.filter(letters, lambda k: k == 1)) >= 4) & (F.size(F.filter(letters, lambda k: k > 1)) <= 1)
    return F.coalesce((n > 0) & (n <= most) & ((n > 1) | has_cjk(body)) & (garbage_ratio(text) == 0) & (other | ~spaced), F.lit(False))
