"""AsciiDoc as elements: one expression cuts a text into its blocks, which then become elements one after the other."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame

from folioflow.sources.elements import Element, gfm, heading, read as read_elements

#: The block forms of the language, one named alternative each; what fits none is a line of prose.
_BLOCKS = re.compile(
    r"""
      ^\[source(?:,(?P<language>[^,\]\n]*))?[^\]\n]*\]\ *\n----\ *\n (?P<listing>.*?) (?:^\ *----\ *$|\Z)
    | ^\ *\.\.\.\.\ *$\n? (?P<literal>.*?) (?:^\ *\.\.\.\.\ *$|\Z)
    | ^\ *\|===\ *$\n? (?P<table>.*?) (?:^\ *\|===\ *$|^(?=[^|\n]*\S[^|\n]*$)|\Z)
    | ^(?P<rank>=+)[\ \t]+(?P<heading>[^\n]*)$
    | ^image::(?P<target>[^\[\n]+)\[(?P<about>[^\n]*)\][\ \t]*$
    | ^(?P<indent>[\ \t]*)(?P<mark>\*|-|\.+|\w+\.)[\ \t]+(?P<item>[^\n]*)$
    | ^(?P<row>[^|\n]{0,12}\|[^\n]*\|[\ \t]*)$
    | ^\.(?P<title>[^\s.][^\n]*)$
    | ^(?P<plus>\ *\+\ *)$
    | ^(?P<blank>[\ \t]*)$
    | ^(?P<prose>[^\n]+)$
    """,
    re.X | re.M | re.S,
)
#: Fixed value: what may stand before a cell's pipe: repeats or spans, alignments, a style letter.
_CELL = re.compile(r"(?:^|(?<=[\s|]))(?:[\d.]+[+*])?(?:\.?[<^>]){0,2}[a-z]?\|")


def _cut(text: str) -> Iterator[tuple[str, re.Match]]:
    """(form, match) of each block; a run of table rows without delimiters is one table."""
    forms = ("listing", "literal", "table", "heading", "target", "item", "row", "title", "plus", "blank", "prose")
    for m in _BLOCKS.finditer(text):
        yield next(f for f in forms if m[f] is not None), m


def _grid(lines: list[str]) -> str:
    return gfm([[c.strip() for c in _CELL.split(line)[1:]] for line in lines if "|" in line])


class _Lists:
    """How deep an item is: by its indent, and by how often its dot is repeated."""

    def __init__(self) -> None:
        self.open: list[int] = []
        self.held = False

    def depth(self, m: re.Match) -> int:
        indent = len(m["indent"]) + (len(m["mark"]) - 1) * (m["mark"][0] == ".")
        inner = [i for i in self.open if i < indent] or self.open[:1] * (indent <= (self.open or [-1])[0])
        self.open = inner if inner and inner[-1] >= indent else [*inner, indent]
        return len(self.open) - 1

    def end(self) -> None:
        if not self.held:
            self.open = []
        self.held = False


def parse(text: str) -> list[Element]:
    """Titles, sections, lists by indent, literal and source blocks, tables, pictures, block titles and paragraphs.

    A block title is the caption of the picture, table, listing or first item that follows; lines of prose after it go
    on with it. A heading does not end a paragraph: only a blank line or a listing does, so text right before a heading
    joins what follows it. A lone + keeps a list open for the block after it.
    """
    found: list[Element] = []
    prose: list[str] = []
    title: list[str] = []
    lists = _Lists()

    def flush(held: list[str], label: str) -> None:
        if held:
            found.append(Element(label, " ".join(held)))
            held.clear()

    for form, run in groupby(_cut(text.removeprefix("﻿").replace("\r\n", "\n")), lambda b: b[0]):
        blocks = [m for _, m in run]
        if form == "row":
            lists.end()
            flush(title, "caption")
            found.append(Element("table", _grid([m["row"] for m in blocks])))
            continue
        for m in blocks:
            if form == "item":
                if not lists.open:
                    flush(title, "caption")
                found.append(Element("list_item", m["item"].strip(), depth=lists.depth(m), marker=m["mark"] if m["mark"][:-1].isdigit() else ""))
                lists.held = False
            elif form == "plus" and lists.open:
                lists.held = True
            elif form == "blank":
                if not title:
                    flush(prose, "text")
            else:
                lists.end()
                if form in ("listing", "literal"):
                    flush(prose, "text")
                    flush(title, "caption")
                    body = "\n".join(line.rstrip("\r") for line in m[form].removesuffix("\n").split("\n"))
                    found.append(Element("code", body, language=(m["language"] or "").strip()))
                elif form == "table":
                    flush(title, "caption")
                    if "|" in m["table"]:
                        found.append(Element("table", _grid(m["table"].split("\n"))))
                elif form == "heading":
                    found.append(heading(len(m["rank"]), m["heading"].strip()))
                elif form == "target":
                    said = " ".join(title) or m["about"].split(",")[0].strip().strip('"')
                    title.clear()
                    found += [Element("picture", m["target"].strip()), *([Element("caption", said)] if said else [])]
                elif form == "title" and not title:
                    title.append(m["title"].strip())
                else:
                    (title or prose).append(m[0].strip())
    flush(prose, "text")
    return found


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Elements of AsciiDoc texts, row by row; a null or empty text has none."""
    return read_elements(docs, parse, id_col, text_col)
