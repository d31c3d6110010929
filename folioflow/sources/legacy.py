"""Office files before 2007: compound files, the text of Word documents, the sheets of BIFF8 workbooks."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from folioflow.sources.elements import Element, gfm

SIGNATURE = bytes.fromhex("d0cf11e0a1b11ae1")
#: Sector numbers from here on are marks, not sectors.
MARKS = 0xFFFFFFFA
#: Cells of a sheet's used range; a larger one is an error of that file.
MAX_CELLS = 100_000


class Compound:
    """The streams of a compound file. Chains that loop or leave the file raise ValueError."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE or len(data) < 512:
            raise ValueError("not a compound file")
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        if shift not in (9, 12) or mini_shift != 6:
            raise ValueError("unknown sector size")
        self.data, self.size = data, 1 << shift
        (directory,) = struct.unpack_from("<I", data, 48)
        self.cutoff, mini_fat, _, more, _ = struct.unpack_from("<5I", data, 56)
        tables, seen = list(struct.unpack_from("<109I", data, 76)), set()
        while more < MARKS:
            if more in seen:
                raise ValueError("sector chain loops")
            seen.add(more)
            *next_tables, more = self._numbers(self._sector(more))
            tables += next_tables
        self.fat = [n for t in tables if t < MARKS for n in self._numbers(self._sector(t))]
        self.entries, root = {}, None
        entries = self._chain(directory)
        for at in range(0, len(entries) - 127, 128):
            length, kind = struct.unpack_from("<HB", entries, at + 64)
            first, size = struct.unpack_from("<II", entries, at + 116)
            if kind == 5:
                root = first, size
            elif kind == 2:
                self.entries.setdefault(entries[at : at + max(min(length, 64) - 2, 0)].decode("utf-16-le", "replace"), (first, size))
        self.mini_fat = self._numbers(self._chain(mini_fat)) if mini_fat < MARKS else []
        self.mini = self._chain(root[0])[: root[1]] if root and root[0] < MARKS else b""

    @staticmethod
    def _numbers(data: bytes) -> list[int]:
        return list(struct.unpack(f"<{len(data) // 4}I", data[: len(data) // 4 * 4]))

    def _sector(self, n: int) -> bytes:
        at = (n + 1) * self.size
        if at >= len(self.data):
            raise ValueError("sector outside the file")
        return self.data[at : at + self.size]

    def _chain(self, n: int) -> bytes:
        out, left = [], len(self.data) // self.size + 1
        while n < MARKS:
            left -= 1
            if left < 0 or n >= len(self.fat):
                raise ValueError("sector chain is broken")
            out.append(self._sector(n))
            n = self.fat[n]
        return b"".join(out)

    def stream(self, name: str) -> bytes | None:
        if name not in self.entries:
            return None
        n, size = self.entries[name]
        if size >= self.cutoff:
            return self._chain(n)[:size]
        out = bytearray()
        while n < MARKS and len(out) < size:
            if n >= len(self.mini_fat):
                raise ValueError("sector chain is broken")
            out += self.mini[n * 64 : n * 64 + 64].ljust(64, b"\0")
            n = self.mini_fat[n]
        return bytes(out[:size])


def _word_text(main: bytes, table: bytes) -> str:
    """The main text, by its table of pieces."""
    (length,) = struct.unpack_from("<I", main, 0x4C)
    at, size = struct.unpack_from("<II", main, 0x1A2)
    pieces, end = table[at : at + size], 0
    while pieces[end : end + 1] == b"\x01":  # formats of runs stand before the pieces
        end += 3 + struct.unpack_from("<H", pieces, end + 1)[0]
    if pieces[end : end + 1] != b"\x02":
        raise ValueError("no table of pieces")
    (size,) = struct.unpack_from("<I", pieces, end + 1)
    body = pieces[end + 5 : end + 5 + size]
    n = (len(body) - 4) // 12
    marks = struct.unpack_from(f"<{n + 1}I", body)
    out = []
    for k in range(n):
        (where,) = struct.unpack_from("<I", body, 4 * (n + 1) + 8 * k + 2)
        chars = min(marks[k + 1], length) - marks[k]
        if chars <= 0:
            continue
        if where & 1 << 30:
            begin = (where & (1 << 30) - 1) // 2
            out.append(main[begin : begin + chars].decode("cp1252", "replace"))
        else:
            out.append(main[where : where + 2 * chars].decode("utf-16-le", "replace"))
    return "".join(out)


#: In Word's text: a field's instructions up to its result, and the marks around and inside of texts.
_INSTRUCTION = re.compile("\x13[^\x13\x14\x15]*[\x14\x15]")
_SAID = str.maketrans({"\x07": " ", "\x0b": "\n", "\x1e": "-", "\xa0": " ", **dict.fromkeys("\x01\x02\x03\x04\x05\x08\x13\x14\x15\x1f")})


def document(data: bytes) -> list[Element]:
    """A Word document's paragraphs as texts: one a line that says something. Field results stay, field instructions go; cells end with a space."""
    file = Compound(data)
    main = file.stream("WordDocument")
    if main is None or len(main) < 0x1AA:
        raise ValueError("no Word document")
    (flags,) = struct.unpack_from("<H", main, 10)
    if flags & 0x0100:
        raise ValueError("encrypted")
    text, inner = _word_text(main, file.stream("1Table" if flags & 0x0200 else "0Table") or b""), 1
    while inner:
        text, inner = _INSTRUCTION.subn("", text)
    return [Element("text", said) for line in re.split(r"[\r\n\f]+", text.translate(_SAID)) if (said := line.strip())]


def _records(stream: bytes, at: int = 0) -> Iterator[tuple[int, bytes]]:
    while at + 4 <= len(stream):
        kind, size = struct.unpack_from("<HH", stream, at)
        if at + 4 + size > len(stream):
            raise ValueError("record outside the stream")
        yield kind, stream[at + 4 : at + 4 + size]
        at += 4 + size


class _Pieces:
    """Strings that go on over several records: each further record says anew how wide its characters are."""

    def __init__(self, records: list[bytes]):
        self.records, self.k, self.at = records, 0, 0

    def left(self) -> int:
        return len(self.records[self.k]) - self.at

    def on(self) -> None:
        self.k, self.at = self.k + 1, 0
        if self.k == len(self.records):
            raise ValueError("strings end too early")

    def take(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if not self.left():
                self.on()
            step = min(n - len(out), self.left())
            out += self.records[self.k][self.at : self.at + step]
            self.at += step
        return out

    def string(self) -> str:
        n, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        extra = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        out = []
        while n:
            if not self.left():
                self.on()
                flags = self.take(1)[0]
            wide = 1 + (flags & 1)
            step = min(n, self.left() // wide)
            if not step:
                raise ValueError("half a character")
            out.append(self.take(step * wide).decode("utf-16-le" if wide == 2 else "latin-1", "replace"))
            n -= step
        self.take(4 * runs + extra)
        return "".join(out)


def _short(data: bytes, wide_length: bool = True) -> str:
    n, flags = struct.unpack_from("<HB" if wide_length else "<BB", data)
    at = 3 if wide_length else 2
    return data[at : at + 2 * n].decode("utf-16-le", "replace") if flags & 1 else data[at : at + n].decode("latin-1")


def _packed(n: int) -> float:
    """The number in four bytes: an integer or the upper half of a double, whole or in hundredths."""
    value = float((n - (1 << 32) if n >> 31 else n) >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & ~3) << 32))[0]
    return value / 100 if n & 1 else value


#: Names of error cells by their code.
ERRORS = {0: "#NULL!", 7: "#DIV/0!", 15: "#VALUE!", 23: "#REF!", 29: "#NAME?", 36: "#NUM!", 42: "#N/A"}


def _sheet(stream: bytes, at: int, strings: list[str], formats: list[int]) -> dict[tuple[int, int], str]:
    cells: dict[tuple[int, int], str] = {}
    depth, formula = 0, None

    def number(row: int, column: int, style: int, value: float) -> None:
        kind = formats[style] if style < len(formats) else 0
        cells[row, column] = f"{value * 100:.0f}%" if kind == 9 else f"{value * 100:.2f}%" if kind == 10 else f"{value:.15g}"

    for kind, body in _records(stream, at):
        if kind == 0x0809:
            depth += 1
        elif kind == 0x000A:
            depth -= 1
            if not depth:
                break
        if depth != 1:  # charts inside the sheet
            continue
        place = struct.unpack_from("<HHH", body) if kind in (0x0006, 0x00BD, 0x00FD, 0x0203, 0x0204, 0x0205, 0x027E) else None
        if kind == 0x00FD:
            (k,) = struct.unpack_from("<I", body, 6)
            cells[place[:2]] = strings[k] if k < len(strings) else ""
        elif kind == 0x0204:
            cells[place[:2]] = _short(body[6:])
        elif kind == 0x0203:
            number(*place, struct.unpack_from("<d", body, 6)[0])
        elif kind == 0x027E:
            number(*place, _packed(struct.unpack_from("<I", body, 6)[0]))
        elif kind == 0x00BD:
            for k in range((len(body) - 6) // 6):
                style, packed = struct.unpack_from("<HI", body, 4 + 6 * k)
                number(place[0], place[1] + k, style, _packed(packed))
        elif kind == 0x0205:
            cells[place[:2]] = ERRORS.get(body[6], "#ERR") if body[7] else ("TRUE" if body[6] else "FALSE")
        elif kind == 0x0006:
            formula = place[:2]
            if body[12:14] != b"\xff\xff":
                number(*place, struct.unpack_from("<d", body, 6)[0])
            elif body[6] in (1, 2):
                cells[formula] = ("TRUE" if body[8] else "FALSE") if body[6] == 1 else ERRORS.get(body[8], "#ERR")
        elif kind == 0x0207 and formula:
            cells[formula] = _short(body)
    return cells


def workbook(data: bytes) -> list[Element]:
    """Each sheet's name as a section header, then its used range as one table. Formulas give the value that was saved, percent formats 9 and 10 are kept."""
    stream = Compound(data).stream("Workbook")
    if stream is None or len(stream) < 8 or struct.unpack_from("<HHH", stream)[::2] != (0x0809, 0x0600):
        raise ValueError("not a BIFF8 workbook")
    sheets, formats, parts, shared = [], [], [], False
    for kind, body in _records(stream):
        if kind == 0x002F:
            raise ValueError("encrypted")
        if kind == 0x000A:
            break
        if kind == 0x00FC or (kind == 0x003C and shared):
            parts.append(body)
        shared = kind == 0x00FC or (kind == 0x003C and shared)
        if kind == 0x00E0:
            formats.append(struct.unpack_from("<H", body, 2)[0])
        elif kind == 0x0085 and body[5] == 0:
            sheets.append((struct.unpack_from("<I", body)[0], _short(body[6:], False)))
    strings = []
    if parts:
        pieces = _Pieces(parts)
        strings = [pieces.string() for _ in range(struct.unpack("<II", pieces.take(8))[1])]
    out = []
    for at, name in sheets:
        cells = {p: t for p, t in _sheet(stream, at, strings, formats).items() if t.strip()}
        rows, columns = (1 + max((p[k] for p in cells), default=-1) for k in (0, 1))
        if rows * columns > MAX_CELLS:
            raise ValueError(f"sheet {name} has too many cells")
        out.append(Element("section_header", name, level=1))
        if cells:
            out.append(Element("table", gfm([[cells.get((r, c), "") for c in range(columns)] for r in range(rows)])))
    return out
