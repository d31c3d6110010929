"""Markdown documents as elements: headings, paragraphs, nested lists, fenced code, pipe tables and pictures."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from folioflow.sources import elements
from folioflow.sources.elements import Element

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)[^`]*$")
_ITEM = re.compile(r"([ \t]*)([-*+]|\d{1,9}[.)])[ \t]+(.*)$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_UNDER = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DIVIDER = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_PICTURE = re.compile(r"!\[([^\]]*)\]\(([^)\s]*)[^)]*\)$")
_SPANS = ((re.compile(r"!?\[([^\]]*)\]\([^)]*\)"), r"\1"), (re.compile(r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![\w*])([*_])(?=\S)(.+?)(?<=\S)\1(?![\w*])"), r"\2"), (re.compile(r"~~(.+?)~~"), r"\1"), (re.compile(r"`+ ?(.+?) ?`+"), r"\1"), (re.compile(r"<(https?://[^>\s]+)>"), r"\1"))


def plain(text: str) -> str:
    """Inline text without its marks."""
    for pattern, by in _SPANS:
        text = pattern.sub(by, text)
    return text


def _cells(line: str) -> list[str]:
    return [plain(c.strip().replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", line.strip().removeprefix("|").removesuffix("|"))]


def parse(text: str) -> list[Element]:
    lines = text.removeprefix("﻿").replace("\r\n", "\n").split("\n")
    out: list[Element] = []
    held: list[str] = []
    indents: list[int] = []
    at = 0

    def flush() -> None:
        said = " ".join(s.strip() for s in held)
        held.clear()
        if picture := _PICTURE.match(said):
            out.extend([Element("picture", picture[2]), *([Element("caption", picture[1])] if picture[1] else [])])
        elif said:
            out.append(Element("text", plain(said)))

    while at < len(lines):
        line = lines[at]
        at += 1
        if fence := _FENCE.match(line):
            flush()
            body = []
            while at < len(lines) and not re.match(rf" {{0,3}}{re.escape(fence[1][0])}{{{len(fence[1])},}}[ \t]*$", lines[at]):
                body.append(lines[at])
                at += 1
            at += 1
            out.append(Element("code", "\n".join(body), language=fence[2]))
        elif not line.strip():
            flush()
            if at < len(lines) and lines[at][:1] not in (" ", "\t") and not _ITEM.match(lines[at]):
                indents.clear()
        elif title := _HEADING.match(line):
            flush()
            indents.clear()
            out.append(elements.heading(len(title[1]), plain((title[2] or "").strip())))
        elif held and (under := _UNDER.match(line)):
            said = plain(" ".join(s.strip() for s in held))
            held.clear()
            out.append(elements.heading(1 if under[1][0] == "=" else 2, said))
        elif _RULE.match(line):
            flush()
        elif "|" in line and at < len(lines) and "-" in lines[at] and _DIVIDER.match(lines[at]) and len(_cells(line)) == len(_cells(lines[at])):
            flush()
            rows = [_cells(line)]
            at += 1
            while at < len(lines) and "|" in lines[at]:
                rows.append(_cells(lines[at])[: len(rows[0])])
                at += 1
            out.append(Element("table", elements.gfm(rows)))
        elif item := _ITEM.match(line):
            flush()
            indent = len(item[1].expandtabs(4))
            while indents and indents[-1] > indent:
                indents.pop()
            if not indents or indent > indents[-1]:
                indents.append(indent)
            out.append(Element("list_item", plain(item[3].strip()), depth=len(indents) - 1, marker=item[2] if item[2][0].isdigit() else "-"))
        elif not held and indents and out and out[-1].label == "list_item" and lines[at - 2].strip():
            out[-1] = out[-1]._replace(text=f"{out[-1].text}\n{plain(line.strip())}")
        else:
            held.append(line.strip().removeprefix("> "))
    flush()
    return out


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return elements.read(docs, parse, id_col, text_col)
