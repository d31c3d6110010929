"""DXF drawings, as text or binary: what they say, in the order of their entities."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from folioflow.sources.elements import Element

BINARY = b"AutoCAD Binary DXF\r\n\x1a\x00"
#: How DWG files begin, and the name of a page that shows the whole drawing.
DWG = re.compile(rb"AC10\d\d|AC1\.[245]|AC2\.1|MC0\.0")
WHOLE = "整图"
#: The version from which on texts are UTF-8, whatever the code page; older files without a code page are read so too.
UNICODE = "AC1021"
#: Texts of a drawing with all its blocks inserted, and blocks inside blocks; beyond them the file is an error.
MAX_TEXTS, MAX_DEPTH = 100_000, 16


def _text_pairs(data: bytes) -> Iterator[tuple[int, bytes]]:
    lines = data.removeprefix(b"\xef\xbb\xbf").splitlines()
    for code, value in zip(lines[::2], lines[1::2], strict=False):
        yield int(code), value


def _width(code: int) -> int | None:
    """Bytes of a binary value by its group code; None for texts and for chunks."""
    if 10 <= code <= 59 or 110 <= code <= 149 or 210 <= code <= 239 or 460 <= code <= 469 or 1010 <= code <= 1059:
        return 8
    if 290 <= code <= 299:
        return 1
    if 90 <= code <= 99 or 420 <= code <= 429 or 440 <= code <= 459 or code == 1071:
        return 4
    if 160 <= code <= 169:
        return 8
    return 2 if 60 <= code <= 79 or 170 <= code <= 179 or 270 <= code <= 289 or 370 <= code <= 389 or 400 <= code <= 409 or 1060 <= code <= 1070 else None


def _binary_pairs(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = len(BINARY)
    while at + 2 <= len(data):
        (code,) = struct.unpack_from("<H", data, at)
        at += 2
        if 310 <= code <= 319 or code == 1004:
            size = 1 + data[at]
        else:
            size = _width(code)
            if size is None:
                end = data.index(b"\0", at)
                yield code, data[at:end]
                at = end + 1
                continue
        yield code, b""
        at += size


_BREAK = re.compile(r"\\[Pp](?![a-z]*[\d,*;])|\^J")
_FORMAT = re.compile(r"\\[ACFHQTWfp][^;]*;|\\[LlOoKk]|(?<!\\)[{}]")
_STACKED = re.compile(r"\\S([^;]*?)[#^/]([^;]*);")
_SIGNS = {"c": "Ø", "d": "°", "p": "±", "%": "%"}


def _signs(text: str) -> str:
    text = re.sub(r"%%([cdp%])", lambda m: _SIGNS[m[1].lower()], text, flags=re.IGNORECASE)
    return re.sub(r"\\U\+([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), re.sub(r"%%[uok]", "", text, flags=re.IGNORECASE))


def plain(text: str) -> str:
    """The words of a formatted text: breaks as line ends, fractions with a slash, escaped signs as themselves."""
    text = _signs(_BREAK.sub("\n", text.replace("\\~", " ")))
    text = _FORMAT.sub("", _STACKED.sub(r"\1/\2", text))
    return re.sub(r"\\([\\{}])", r"\1", text).strip()


def _records(data: bytes) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(type, group codes and values) of each record, in the drawing's own encoding."""
    pairs = list(_binary_pairs(data) if data.startswith(BINARY) else _text_pairs(data))
    said = {name: value.strip().decode("ascii", "replace") for (_, name), (_, value) in zip(pairs, pairs[1:], strict=False) if name.strip() in (b"$ACADVER", b"$DWGCODEPAGE")}
    page, version = said.get(b"$DWGCODEPAGE", "")[5:], said.get(b"$ACADVER", "")
    encoding = "utf-8"
    if page and version < UNICODE:
        encoding = {"932": "cp932", "936": "gbk", "949": "cp949", "950": "cp950"}.get(page, f"cp{page}")
    kind, held = "", []
    for code, value in pairs:
        if code == 0:
            if kind:
                yield kind, held
            kind, held = value.decode("ascii", "replace").strip(), []
        else:
            held.append((code, value.decode(encoding, "replace")))
    if kind:
        yield kind, held


def drawing(data: bytes) -> list[Element]:
    """A section header, then the texts of the drawing; those of a block stand wherever it is inserted, attributes after it.

    DWG files, files without sections and drawings of more than MAX_TEXTS texts raise ValueError.
    """
    if DWG.match(data):
        raise ValueError("DWG isn't read")
    if not data.startswith(BINARY) and not re.search(rb"^\s*(0\s*\r?\n\s*SECTION|999)\s*$", data.removeprefix(b"\xef\xbb\xbf")[:4096], re.MULTILINE):
        raise ValueError("not a drawing")
    section, block = "", None
    blocks: dict[str, list[tuple[str, str]]] = {}
    model: list[tuple[str, str]] = []
    for kind, values in _records(data):
        one = dict(reversed(values))
        if kind == "SECTION":
            section = one.get(2, "")
        elif kind == "BLOCK":
            block = blocks.setdefault(one.get(2, "").lower(), [])
        elif kind == "ENDBLK":
            block = None
        elif section in ("BLOCKS", "ENTITIES"):
            into = model if section == "ENTITIES" else block if block is not None else []
            if kind == "INSERT":
                into.append(("block", one.get(2, "").lower()))
            elif kind == "MTEXT":
                into.append(("text", plain("".join(v for c, v in values if c == 3) + one.get(1, ""))))
            elif kind in ("TEXT", "ATTRIB"):
                into.append(("text", _signs(one.get(1, "")).strip()))
    out = [Element("section_header", WHOLE, level=1)]

    def say(parts: list[tuple[str, str]], depth: int) -> None:
        for kind, value in parts:
            if kind == "block":
                if depth >= MAX_DEPTH:
                    raise ValueError("blocks too deep")
                say(blocks.get(value, []), depth + 1)
            elif value:
                out.append(Element("text", value))
                if len(out) > MAX_TEXTS:
                    raise ValueError("too many texts")

    say(model, 0)
    return out
