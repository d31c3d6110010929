"""Word, PowerPoint and Excel files (Office Open XML) as elements, by the parts of their archive."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from folioflow.sources import charts, formulas
from folioflow.sources.elements import Element, gfm

#: Bytes of a part, unpacked; a longer one is an error of that file.
MAX_PART = 512 << 20
#: Fixed value: shapes whose tops are this close (in EMU, a twentieth of an inch) stand in one row.
ROW = 45_720
Grid = dict[tuple[int, int], str]


def _name(node) -> str:
    return node.tag.rpartition("}")[2]


def _find(node, *path: str):
    """The first descendant along a path of child names, whatever their namespace."""
    for step in path:
        node = next((c for c in node if _name(c) == step), None) if node is not None else None
    return node


def _all(node, name: str) -> Iterator:
    return (e for e in node.iter() if _name(e) == name) if node is not None else iter(())


def _get(node, name: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    return next((v for k, v in node.attrib.items() if k.rpartition("}")[2] == name), default) if node is not None else default


class Package:
    """An archive's parts and their relationships; names that leave the archive are not followed."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, path: str | None):
        if path is None or path not in self.names:
            return None
        if self.zip.getinfo(path).file_size > MAX_PART:
            raise ValueError("part too large")
        return ElementTree.fromstring(self.zip.read(path))

    def related(self, path: str, kind: str = "") -> dict[str, str]:
        """Part paths by relationship id, of those whose type ends in kind."""
        folder, name = posixpath.split(path)
        out = {}
        for r in _all(self.xml(f"{folder}/_rels/{name}.rels".lstrip("/")), "Relationship"):
            if r.get("TargetMode") != "External" and r.get("Type", "").endswith(kind):
                target = r.get("Target", "")
                part = posixpath.normpath(target.lstrip("/") if target.startswith("/") else posixpath.join(folder, target))
                if not part.startswith(".."):
                    out[r.get("Id", "")] = part
        return out

    def main(self, default: str) -> str:
        return next(iter(self.related("", "/officeDocument").values()), default)


def regions(cells: set[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Cells that touch by a side, each region sorted, in the order of their first cells."""
    left, out = set(cells), []
    for start in sorted(cells):
        if start not in left:
            continue
        left.remove(start)
        found, edge = [start], [start]
        while edge:
            r, c = edge.pop()
            for near in ((r, c + 1), (r, c - 1), (r + 1, c), (r - 1, c)):
                if near in left:
                    left.remove(near)
                    found.append(near)
                    edge.append(near)
        out.append(sorted(found))
    return out


def cell_place(ref: str) -> tuple[int, int]:
    """(row, column) from 0 of a reference such as B7."""
    letters, digits = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", ref).groups()
    column = 0
    for c in letters.upper():
        column = column * 26 + ord(c) - 64
    return int(digits) - 1, column - 1


def _strings(package: Package, workbook: str) -> list[str]:
    """Shared strings, without the readings of phonetic runs."""
    path = next(iter(package.related(workbook, "/sharedStrings").values()), None)
    return ["".join(t.text or "" for r in (si, *(c for c in si if _name(c) == "r")) for t in r if _name(t) == "t") for si in _all(package.xml(path), "si")]


def _value(cell, shared: list[str]) -> str:
    kind, v = cell.get("t", "n"), _find(cell, "v")
    said = (v.text or "") if v is not None else ""
    if kind == "s":
        return shared[int(said)] if said.isdigit() and int(said) < len(shared) else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(_find(cell, "is"), "t"))
    if kind == "b":
        return {"1": "TRUE", "0": "FALSE"}.get(said, said)
    formula = _find(cell, "f")
    return said or (f"={formula.text}" if formula is not None and formula.text else "")


def _sheet(root, shared: list[str]) -> list[Element]:
    grid: Grid = {}
    for cell in _all(_find(root, "sheetData"), "c"):
        if text := _value(cell, shared):
            grid[cell_place(cell.get("r"))] = text
    spans: dict[tuple[int, int], tuple[int, int]] = {}
    shadows: set[tuple[int, int]] = set()
    for merged in _all(root, "mergeCell"):
        (r0, c0), (r1, c1) = (cell_place(x) for x in (merged.get("ref", "A1").split(":") * 2)[:2])
        spans[r0, c0] = r1 - r0 + 1, c1 - c0 + 1
        shadows |= {(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)}
    out = []
    for region in regions(set(grid) | shadows):
        top, left = min(r for r, _ in region), min(c for _, c in region)
        height, width = max(r for r, _ in region) - top + 1, max(c for _, c in region) - left + 1
        if len(region) == 1:
            out.append(Element("text", grid.get(region[0], "")))
            continue
        rows = [[grid.get((top + r, left + c), "") for c in range(width)] for r in range(height)]
        for (r0, c0), (tall, wide) in spans.items():  # a merged cell says its text in all of its places
            for r, c in ((r, c) for r in range(r0, r0 + tall) for c in range(c0, c0 + wide) if (r0, c0) in region):
                rows[r - top][c - left] = grid.get((r0, c0), "")
        tall, wide = spans.get((top, left), (1, 1))
        says = [(r, c) for r, c in region if grid.get((r, c))]
        heads = sum(1 for r, c in says if r == top + 1 and spans.get((r, c), (1, 1))[1] == 1)
        if height > 1 and tall == 1 and wide > 1 and [p for p in says if p[0] == top] == [(top, left)] and heads > 1:
            out.append(Element("text", rows.pop(0)[0]))
        out.append(Element("table", gfm(rows)))
    return [e for e in out if e.text]


def workbook(data: bytes) -> list[Element]:
    """Each sheet's name as a section header, then its regions: cells that touch are a table, lone ones texts.

    A first row of one cell over several columns is a text above its table. Merged cells repeat their text, formulas
    give their last value. Hidden sheets are of the layer invisible.
    """
    package = Package(data)
    main = package.main("xl/workbook.xml")
    shared, parts, out = _strings(package, main), package.related(main, "/worksheet"), []
    for sheet in _all(_find(package.xml(main), "sheets"), "sheet"):
        layer = "body" if sheet.get("state", "visible") == "visible" else "invisible"
        out.append(Element("section_header", sheet.get("name", ""), level=1, layer=layer))
        root = package.xml(parts.get(_get(sheet, "id", "")))
        out += [e._replace(layer=layer) for e in (_sheet(root, shared) if root is not None else [])]
        for drawing in package.related(parts[_get(sheet, "id", "")], "/drawing").values() if root is not None else ():
            out += [e._replace(layer=layer) for e in _charts(package, drawing, package.xml(drawing))]
    return out


def _charts(package: Package, path: str, node) -> list[Element]:
    """The charts that a part's node shows, in its order; a broken chart is left out."""
    frames, out = list(_all(node, "chart")), []
    parts = package.related(path, "/chart") if frames else {}
    for frame in frames:
        part = parts.get(_get(frame, "id", ""))
        try:
            out += charts.elements(package.zip.read(part)) if part in package.names and package.zip.getinfo(part).file_size <= MAX_PART else []
        except (ElementTree.ParseError, ValueError):
            continue
    return out


class _Word:
    """A Word document's styles and numberings, and what its paragraphs and tables say."""

    def __init__(self, package: Package, main: str):
        one = lambda kind: package.xml(next(iter(package.related(main, kind).values()), None))
        self.styles = {_get(s, "styleId", ""): s for s in _all(one("/styles"), "style")}
        numbering = one("/numbering")
        formats = {(_get(a, "abstractNumId"), _get(level, "ilvl")): _get(_find(level, "numFmt"), "val", "bullet") for a in _all(numbering, "abstractNum") for level in _all(a, "lvl")}
        base = {_get(n, "numId"): _get(_find(n, "abstractNumId"), "val") for n in _all(numbering, "num")}
        self.ordered = lambda num, level: formats.get((base.get(num), level), "bullet") not in ("bullet", "none")
        self.counts: dict[tuple[str, int], int] = {}
        self.deleted: list[str] = []
        self.package, self.part = package, main

    def kind(self, style: str) -> tuple[str, int]:
        """(label, level) of a style: headings by its own or its base's name or outline, the title, code along its bases."""
        name = lambda s: (_get(_find(self.styles[s], "name"), "val", "") if s in self.styles else "").lower()
        base = lambda s: _get(_find(self.styles[s], "basedOn"), "val", "") if s in self.styles else ""
        outline = _get(_find(self.styles[style], "pPr", "outlineLvl"), "val", "") if style in self.styles else ""
        level = int(outline) + 1 if outline.isdigit() and int(outline) < 9 else 0
        names = (style.lower(), name(style), base(style).lower(), name(base(style)))
        if any("heading" in n for n in names):
            numbers = [int(m[1]) for n in names if (m := re.search(r"heading\s*(\d)", n))]
            return "section_header", level or (numbers[0] if numbers else 1)
        at = style
        for _ in range(10):
            if re.search(r"\bcode\b|source code|preformatted", f"{at.lower()} {name(at)}"):
                return "code", 0
            if not (at := base(at)):
                break
        if level and not any("title" in n for n in names):
            return "section_header", level
        return ("title", 0) if "title" in (style.lower(), name(style)) else ("text", 0)

    def text(self, node) -> str:
        """A paragraph as all changes leave it; what they delete is kept apart."""
        out: list[str] = []
        for child in node:
            kind = _name(child)
            if kind in ("t", "delText"):
                out.append(child.text or "")
            elif kind == "oMath":
                out.append(formulas.latex(child))
            elif kind in ("tab", "br", "cr"):
                out.append("\t" if kind == "tab" else "\n")
            elif kind in ("del", "moveFrom"):
                if said := self.text(child):
                    self.deleted.append(said)
            elif kind not in ("pPr", "rPr", "instrText", "drawing", "pict", "AlternateContent"):
                out.append(self.text(child))
        return "".join(out)

    def paragraph(self, p) -> list[Element]:
        text = self.text(p).strip()
        math = "".join(formulas.latex(m) for m in _all(p, "oMath"))
        label, level = self.kind(_get(_find(p, "pPr", "pStyle"), "val", ""))
        number = _find(p, "pPr", "numPr")
        num, depth = _get(_find(number, "numId"), "val", "0") if number is not None else "0", int(_get(_find(number, "ilvl"), "val", "0")) if number is not None else 0
        out = []
        if text and label == "text" and num != "0":
            self.counts = {k: n for k, n in self.counts.items() if k[0] != num or k[1] <= depth}
            self.counts[num, depth] = n = self.counts.get((num, depth), 0) + 1
            out.append(Element("list_item", text, depth=depth, marker=f"{n}." if self.ordered(num, str(depth)) else ""))
        elif text and label != "section_header" and "".join(text.split()) == "".join(math.split()):
            out.append(Element("formula", text))
        elif text:
            out.append(Element(label, text, level=level))
        for box in self.boxes(p):
            out += self.body(box)
        out += [Element("text", said, layer="notes") for said in self.deleted] + _charts(self.package, self.part, p)
        self.deleted = []
        return out

    def boxes(self, node) -> Iterator:
        """The text boxes that hang on a paragraph; of several versions of one the first."""
        for child in node:
            kind = _name(child)
            if kind == "txbxContent":
                yield child
            elif kind == "AlternateContent":
                yield from self.boxes(next(iter(child), ()))
            else:
                yield from self.boxes(child)

    def table(self, t) -> Element:
        """Cells by their place in the grid: spans repeat their text, cells that go on from above take it from there."""
        rows: list[list[str]] = []
        for tr in (c for c in t if _name(c) == "tr"):
            row = [""] * int(_get(_find(tr, "trPr", "gridBefore"), "val", "0"))
            for tc in (c for c in tr if _name(c) == "tc"):
                said = "\n".join(x for x in (self.text(p).strip() for p in _all(tc, "p")) if x)
                merge = _find(tc, "tcPr", "vMerge")
                if merge is not None and _get(merge, "val", "continue") == "continue" and rows:
                    said = rows[-1][len(row)] if len(row) < len(rows[-1]) else ""
                row += [said] * int(_get(_find(tc, "tcPr", "gridSpan"), "val", "1"))
            rows.append(row)
        self.deleted = []
        return Element("table", gfm(rows))

    def body(self, node) -> list[Element]:
        out: list[Element] = []
        for child in node if node is not None else ():
            kind = _name(child)
            if kind == "p":
                out += self.paragraph(child)
            elif kind == "tbl":
                out.append(self.table(child))
            elif kind in ("sdt", "sdtContent", "customXml", "ins", "moveTo"):
                out += self.body(child)
        return out


def _merged_code(found: list[Element]) -> list[Element]:
    out: list[Element] = []
    for e in found:
        if e.label == "code" and out and out[-1].label == "code":
            out[-1] = out[-1]._replace(text=f"{out[-1].text}\n{e.text}")
        else:
            out.append(e)
    return out


def document(data: bytes) -> list[Element]:
    """Page headers and footers as furniture, then paragraphs by style, lists by numbering and tables in their order, then foot notes, end notes and comments as notes."""
    package = Package(data)
    main = package.main("word/document.xml")
    word, out = _Word(package, main), []
    for kind, label in (("/header", "page_header"), ("/footer", "page_footer")):
        for path in sorted(set(package.related(main, kind).values())):
            word.part = path
            said = " ".join(e.text for e in word.body(package.xml(path)) if e.layer == "body")
            out += [Element(label, said, layer="furniture")] if said else []
    word.part = main
    out += _merged_code(word.body(_find(package.xml(main), "body")))
    for kind, part in (("/footnotes", "footnote"), ("/endnotes", "endnote"), ("/comments", "comment")):
        for path in package.related(main, kind).values():
            word.part = path
            for note in _all(package.xml(path), part):
                said = "\n".join(e.text for e in word.body(note))
                if said and _get(note, "type") not in ("separator", "continuationSeparator"):
                    out.append(Element("text", said, layer="notes"))
    return out


def _shape_paragraphs(shape) -> list[Element]:
    kind = _get(_find(shape, "nvSpPr", "nvPr", "ph"), "type", "")
    out = []
    count = 0
    for p in _all(_find(shape, "txBody"), "p"):
        said = "".join(t.text or "" if _name(t) == "t" else "\n" for t in p.iter() if _name(t) in ("t", "br")).strip()
        if not said:
            continue
        ppr = _find(p, "pPr")
        numbered, bullet, none = (_find(ppr, x) is not None for x in ("buAutoNum", "buChar", "buNone"))
        count = count + 1 if numbered else 0
        depth = int(_get(ppr, "lvl", "0"))
        if kind in ("title", "ctrTitle"):
            out.append(Element("title", said))
        elif kind in ("ftr", "hdr", "dt", "sldNum"):
            out.append(Element("page_header" if kind == "hdr" else "page_footer", said, layer="furniture"))
        elif not none and (numbered or bullet or (kind in ("body", "obj") and ppr is not None and "lvl" in ppr.attrib)):
            out.append(Element("list_item", said, depth=depth, marker=f"{count}." if numbered else ""))
        else:
            out.append(Element("text", said))
    return out


def _shapes(tree, dx: float = 0, dy: float = 0) -> list[tuple[float, float, list[Element]]]:
    """(top, left, elements) of shapes; groups move what they hold."""
    out = []
    for shape in tree if tree is not None else ():
        kind = _name(shape)
        if kind not in ("sp", "graphicFrame", "pic", "grpSp"):
            continue
        form = _find(shape, "xfrm") if kind == "graphicFrame" else _find(shape, "grpSpPr" if kind == "grpSp" else "spPr", "xfrm")
        off, inner = _find(form, "off"), _find(form, "chOff")
        x, y = (float(_get(off, "x", "0")) + dx, float(_get(off, "y", "0")) + dy) if off is not None else (dx, dy)
        if kind == "grpSp":
            out += _shapes(shape, x - float(_get(inner, "x", "0")), y - float(_get(inner, "y", "0")))
        elif kind == "sp":
            out.append((y, x, _shape_paragraphs(shape)))
        elif kind == "pic":
            out.append((y, x, [Element("picture", _get(_find(shape, "nvPicPr", "cNvPr"), "descr", "") or "")]))
        else:
            rows = [["\n".join(said for p in _all(tc, "p") if (said := "".join(t.text or "" for t in _all(p, "t")).strip())) for tc in _all(tr, "tc")] for tr in _all(shape, "tr")]
            out.append((y, x, [Element("table", gfm(rows))] if rows else []))
    return out


def in_rows(shapes: list[tuple[float, float, list[Element]]]) -> list[Element]:
    """From the top down; shapes whose tops follow each other within ROW are read from the left."""
    rows: list[list[tuple[float, float, list[Element]]]] = []
    for shape in sorted(shapes, key=lambda s: s[0]):
        if rows and shape[0] - rows[-1][-1][0] <= ROW:
            rows[-1].append(shape)
        else:
            rows.append([shape])
    return [e for row in rows for _, _, found in sorted(row, key=lambda s: s[1]) for e in found]


def slides(data: bytes) -> list[Element]:
    """Slides in the order of the presentation: titles, texts, lists, tables and pictures by place, then the speaker's notes."""
    package = Package(data)
    main = package.main("ppt/presentation.xml")
    parts, out = package.related(main, "/slide"), []
    for slide in _all(_find(package.xml(main), "sldIdLst"), "sldId"):
        path = next((v for k, v in slide.attrib.items() if k.endswith("}id")), "")
        root = package.xml(parts.get(path))
        if root is None:
            continue
        out += in_rows(_shapes(_find(root, "cSld", "spTree"))) + _charts(package, parts[path], root)
        for notes in package.related(parts[path], "/notesSlide").values():
            out += [e._replace(layer="notes", label="text") for e in in_rows(_shapes(_find(package.xml(notes), "cSld", "spTree"))) if e.layer == "body" and e.text]
    return out


def core_properties(data: bytes) -> dict[str, str]:
    """Title, creator, subject, language and date of any such file, as far as it says them."""
    root = Package(data).xml("docProps/core.xml")
    return {_name(e): e.text.strip() for e in (root if root is not None else ()) if _name(e) in ("title", "creator", "subject", "language", "created") and (e.text or "").strip()}
