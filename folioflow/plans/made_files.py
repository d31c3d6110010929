"""Files that queries and tests make: compound files, workbooks and Word documents of before 2007, drawings and charts."""

from __future__ import annotations

import struct
from xml.sax.saxutils import escape


def compound(streams: dict[str, bytes]) -> bytes:
    """A compound file of up to three streams; those below 4096 bytes share the small sectors."""
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    pad = lambda data, size: data + b"\0" * (-len(data) % size)
    fat, mini_fat, body, mini, places = [0xFFFFFFFD, end, end], [], b"", b"", {}

    def chain(table: list[int], n: int) -> int:
        at = len(table)
        table += [*range(at + 1, at + n), end]
        return at

    for name, data in streams.items():
        if len(data) < 4096:
            places[name] = chain(mini_fat, max(len(pad(data, 64)) // 64, 1))
            mini += pad(data, 64) or b"\0" * 64
        else:
            places[name] = chain(fat, len(pad(data, 512)) // 512)
            body += pad(data, 512)
    root = chain(fat, len(pad(mini, 512)) // 512) if mini else end
    body += pad(mini, 512)

    def entry(name: str, kind: int, first: int, size: int) -> bytes:
        said = name.encode("utf-16-le") + b"\0\0"
        return said.ljust(64, b"\0") + struct.pack("<HBB", len(said), kind, 1) + struct.pack("<3I", free, free, free) + bytes(36) + struct.pack("<IQ", first, size)

    directory = entry("Root Entry", 5, root, len(mini)) + b"".join(entry(n, 2, places[n], len(d)) for n, d in streams.items())
    tables = [struct.pack("<128I", *(t + [free] * (128 - len(t)))) for t in (fat, mini_fat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<5H", 62, 3, 0xFFFE, 9, 6) + bytes(10) + struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2, 1, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return head + tables[0] + directory.ljust(512, b"\0") + tables[1] + body


def record(kind: int, body: bytes) -> bytes:
    return struct.pack("<HH", kind, len(body)) + body


def biff_string(text: str) -> bytes:
    return struct.pack("<HB", len(text), 1) + text.encode("utf-16-le")


def biff(sheets: dict[str, list[bytes]], shared: list[bytes], formats: tuple[int, ...] = (0, 9, 10)) -> bytes:
    """The stream of a workbook: cell records by sheet, records of shared strings as they are."""
    begin = lambda kind: record(0x0809, struct.pack("<HHHHII", 0x0600, kind, 0, 0, 0, 0))
    styles = b"".join(record(0x00E0, struct.pack("<HH", 0, f) + bytes(16)) for f in formats)
    names = [record(0x0085, struct.pack("<IBBBB", 0, 0, 0, len(n), 1) + n.encode("utf-16-le")) for n in sheets]
    head = begin(5) + styles
    at = len(head) + sum(map(len, names)) + sum(map(len, shared)) + 4
    bodies = [begin(16) + b"".join(cells) + record(0x000A, b"") for cells in sheets.values()]
    for k, name in enumerate(names):
        names[k] = name[:4] + struct.pack("<I", at) + name[8:]
        at += len(bodies[k])
    return head + b"".join(names) + b"".join(shared) + record(0x000A, b"") + b"".join(bodies)


def old_workbook(name: str, segment: str, key: int) -> bytes:
    """One sheet: name and segment as shared strings, the key as a number, a packed number and a percentage."""
    strings = record(0x00FC, struct.pack("<II", 4, 4) + b"".join(map(biff_string, ("name", "segment", name, segment))))
    text = lambda r, c, k: record(0x00FD, struct.pack("<HHHI", r, c, 0, k))
    cells = [text(0, 0, 0), text(0, 1, 1), text(1, 0, 2), text(1, 1, 3), record(0x0203, struct.pack("<HHHd", 2, 0, 0, key)), record(0x027E, struct.pack("<HHHI", 2, 1, 0, key << 2 | 2)), record(0x0203, struct.pack("<HHHd", 2, 2, 1, key / 100))]
    return compound({"Workbook": biff({"Sheet": cells}, [strings])})


def old_document(parts: list[str], flags: int = 0x0200, main: int | None = None) -> bytes:
    """A Word document whose text is in pieces: those in the Western code page as bytes, others as UTF-16."""
    body, places, marks = b"", [], [0]
    for part in parts:
        at = 0x400 + len(body)
        try:
            said, mark = part.encode("cp1252"), at * 2 | 1 << 30
        except UnicodeEncodeError:
            said, mark = part.encode("utf-16-le"), at
        body += said + b"\0" * (-len(said) % 2)
        places.append(struct.pack("<HIH", 0, mark, 0))
        marks.append(marks[-1] + len(part))
    pieces = struct.pack(f"<{len(marks)}I", *marks) + b"".join(places)
    table = b"\x01" + struct.pack("<H", 2) + b"xx" + b"\x02" + struct.pack("<I", len(pieces)) + pieces
    head = bytearray(0x400)
    struct.pack_into("<HH", head, 0, 0xA5EC, 0xC1)
    struct.pack_into("<H", head, 10, flags)
    struct.pack_into("<I", head, 0x4C, marks[-1] if main is None else main)
    struct.pack_into("<II", head, 0x1A2, 0, len(table))
    return compound({"WordDocument": bytes(head) + body, "1Table": table})


def drawing(name: str, segment: str, key: int) -> bytes:
    """A drawing of a formatted text, a plain one and a block that is inserted twice."""
    block = f"0\nBLOCK\n2\nB\n0\nTEXT\n1\n{key}%%d\n0\nENDBLK\n"
    insert = "0\nINSERT\n2\nb\n"
    return f"0\nSECTION\n2\nBLOCKS\n{block}0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nMTEXT\n3\n{{\\fArial|b0;{name}}}\n1\n\\P{segment}\n{insert}0\nTEXT\n8\n0\n1\n{name}\n{insert}0\nENDSEC\n0\nEOF\n".encode()


def chart(name: str, key: int) -> bytes:
    """A bar chart with a line: one series with a name and a gap, one without a name, and for every other key a bubble series."""
    pts = lambda *v: "".join(f'<pt idx="{i}"><v>{escape(str(x))}</v></pt>' for i, x in v)
    first = f"<ser><tx><strRef><f>A1</f><strCache>{pts((0, name))}</strCache></strRef></tx><cat><strRef><f>S!A</f><strCache>{pts((0, 'a'), (2, 'c'))}</strCache></strRef></cat><val><numRef><numCache>{pts((0, key), (2, key + 2))}</numCache></numRef></val></ser>"
    second = f"<ser><val><numLit>{pts((1, key * 2))}</numLit></val></ser>"
    third = f"<bubbleChart><ser><xVal><numLit>{pts((0, 7))}</numLit></xVal><yVal><numLit>{pts((0, 8))}</numLit></yVal><bubbleSize><numLit>{pts((0, 9))}</numLit></bubbleSize></ser></bubbleChart>" if key % 2 else ""
    return f'<c:chartSpace xmlns:c="c"><c:title><t>Chart </t><t>{escape(name)}</t></c:title><plotArea><barChart>{first}</barChart><bar3DChart>{second}</bar3DChart>{third}</plotArea></c:chartSpace>'.encode()
