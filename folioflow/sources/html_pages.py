"""HTML documents as elements."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame

from folioflow.sources import elements, grids
from folioflow.sources.elements import Element

#: Fixed values of HTML: elements without an end tag, without text of the page, and those that end a paragraph.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset("script style noscript template".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Fixed values of HTML: start tags that stand for the end tags of what they follow.
ENDED_BY = {"li": ("p", "li"), "dt": ("p", "dt", "dd"), "dd": ("p", "dt", "dd"), "td": ("p", "td", "th"), "th": ("p", "td", "th"), "tr": ("p", "td", "th", "tr")} | dict.fromkeys(BLOCK - {"li", "dt", "dd", "td", "th", "tr"}, ("p",))
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in SILENT or "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() in ("true", "1", "yes") or "display:none" in (attrs.get("style") or "").replace(" ", "").lower()


class _Reader(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[Element] = []
        self.open: list[tuple[str, bool]] = []  # element, and whether it or one around it is hidden
        self.now: list[str] = []
        self.lists: list[list] = []  # kind, number of the last item
        self.rows: list[list[tuple[str, int, int, str]]] | None = None
        self.spans = (1, 1)
        self.marker = ""

    def flush(self) -> None:
        raw, self.now = "".join(self.now), []
        names = [n for n, _ in self.open]
        if "pre" in names:
            if raw.strip():
                self.out.append(Element("code", raw.strip("\n")))
            return
        said = "\n".join(s for s in (" ".join(line.split()) for line in raw.split("\v")) if s)
        if not said:
            return
        rank = next((HEADINGS.index(n) + 1 for n in reversed(names) if n in HEADINGS), 0)
        if "title" in names:
            self.out.append(Element("title", said, layer="furniture"))
        elif rank:
            self.out.append(elements.heading(rank, said))
        elif self.lists and "li" in names:
            self.out.append(Element("list_item", said, depth=len(self.lists) - 1, marker=self.marker or "-"))
        else:
            self.out.append(Element("caption" if "figcaption" in names else "text", said))

    def _tables(self) -> int:
        return sum(n == "table" for n, _ in self.open)

    def _counts(self) -> bool:
        """Whether a row or cell here is one of the outermost table, and not of its foot."""
        return self.rows is not None and self._tables() == 1 and all(n != "tfoot" for n, _ in self.open)

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        shut = bool(self.open and self.open[-1][1]) or hidden(tag, a)
        while self.open and self.open[-1][0] in ENDED_BY.get(tag, ()):
            self.handle_endtag(self.open[-1][0])
        if (tag in BLOCK or tag == "title") and self.rows is None:
            self.flush()
        if tag == "br":
            self.now.append("\v")
        elif tag == "img" and not shut and self.rows is None:
            self.flush()
            self.out.extend([Element("picture", a.get("src", "")), *([Element("caption", a["alt"])] if a.get("alt") else [])])
        if tag in VOID:
            return
        self.open.append((tag, shut))
        if shut:
            return
        if tag in ("ul", "ol"):
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            self.marker = f"{self.lists[-1][1]}." if self.lists[-1][0] == "ol" else "-"
        elif tag == "table" and self.rows is None:
            self.rows = []
        elif tag == "tr" and self._counts():
            self.rows.append([])
        elif tag in ("td", "th") and self._counts():
            self.spans = (grids.span(a.get("rowspan")), grids.span(a.get("colspan")))

    def handle_endtag(self, tag: str) -> None:
        if all(n != tag for n, _ in self.open):
            return
        while True:
            name, shut = self.open[-1]
            if name in ("td", "th") and self.rows and self._counts():
                self.rows[-1].append((name, *self.spans, " ".join("".join(self.now).split())))
                self.now = []
            elif name in ("td", "th") and self.rows is not None:
                self.now = self.now + [" "] if self._tables() > 1 else []
            elif name == "table" and self.rows is not None and self._tables() == 1:
                rows = grids.filled(grids.grid([r for r in self.rows if r]))
                if any(map(any, rows)):
                    self.out.append(Element("table", elements.gfm(rows)))
                self.rows, self.now = None, []
            elif (name in BLOCK or name == "title") and self.rows is None:
                self.flush()
            if name in ("ul", "ol") and self.lists and not shut:
                self.lists.pop()
            self.open.pop()
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.now.append(data)


def parse(text: str) -> list[Element]:
    """Elements in page order. With a heading on the page, what stands before the first one is furniture."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    reader.flush()
    first = next((k for k, e in enumerate(reader.out) if e.layer == "body" and e.label in ("title", "section_header")), 0)
    return [e._replace(layer="furniture") if k < first else e for k, e in enumerate(reader.out)]


def read(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return elements.read(pages, parse, id_col, html_col)
