"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' shape."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, texts

#: Fixed values of HTML: elements whose tags end a block, that hold no text of the page, and that may hold blocks.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
SILENT = frozenset("head template noscript svg math object select button canvas audio video datalist".split())
HOLDER = frozenset("article aside body details dialog div dl fieldset figure footer form head header main menu nav noscript ol section svg template table object select button ul center math canvas audio video datalist".split())
FRAME = frozenset("nav footer aside form menu dialog fieldset".split())
#: Roles that say the same as such an element.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu".split())
#: Words in class, id and role of boxes around an article, but also of wrappers around all of a page.
HINT = re.compile(r"(?<![a-z])(?:nav|navbar|navigation|menu|sidebar|side|footer|foot|header|masthead|banner|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|search|share|sharing|social|breadcrumbs?|pagination|pager|related|recommend\w*|comments?|commentlist|repl(?:y|ies)|disqus|respond|discussion|feedback|reviews?|widgets?|toolbar|copyright|legal|disclaimer|teasers?|trending|complementary|contentinfo)(?![a-z])")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Of these, the words of boxes that hold no text of the article even inside it.
STRONG = re.compile(r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|newsletter|share|sharing|social|breadcrumbs?|related|comments?|commentlist|disqus|respond)(?![a-z])")
#: A box with such a word is one if this share of the page's unframed words (or of the article's, inside it) stands outside.
BOX = 0.7
#: What stands in copyright lines.
_MARK = re.compile(r"\s*(?:©|\(c\)|copyright\b)|all rights reserved", re.I)
FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "heading_before", "heading_after", "near", "mark")
#: Blocks on each side whose unlinked words count as near.
NEAR = 3


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\t\n\r") else {}


def _hidden(a: dict[str, str]) -> bool:
    return "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").lower().replace(" ", "")


class Block(NamedTuple):
    """A flat text block: its shape, and what the markup says of it."""

    text: str
    words: int
    linked: int
    heading: bool
    framed: bool
    article: bool
    boxed: float


def blocks(page: str | None) -> list[Block]:
    """The blocks with text, in page order.

    boxed is 0 without a hint around the block, and else the share of the unframed words of the page (of all articles,
    for a strong hint inside one) that stand outside the innermost element with one: near 0 in a wrapper of the page,
    near 1 in a small box. An article resets the hints around it.
    """
    page = page or ""
    limit = page.rfind(">") + 1  # beyond it no tag can end
    out: list[tuple] = []
    stack: list[tuple] = []  # element, and then for it and all around it: silent, framed, article, innermost hint that counts, innermost hint
    hints: list[list[int]] = []  # of each element with a hint: the one around it, or -1, and its unframed words
    words = in_articles = 0
    now, linked = [], []
    in_link, heading, at = 0, False, 0
    endless: set[str] = set()

    def state() -> tuple[bool, bool, bool, int, int]:
        return stack[-1][1:] if stack else (False, False, False, -1, -1)

    def close() -> None:
        nonlocal now, linked, words, in_articles
        text = " ".join("".join(now).split())
        if text:
            _, framed, article, hint, around = state()
            n = len(text.split(" "))
            out.append((text, n, len("".join(linked).split()), heading, framed, article, hint))
            if not framed:
                words += n
                in_articles += n * article
                while around >= 0:
                    hints[around][1] += n
                    around = hints[around][0]
        now, linked = [], []

    def put(raw: str) -> None:
        if raw and not state()[0]:
            text = html.unescape(raw) if "&" in raw else raw
            now.append(text)
            if in_link:
                linked.append(text)

    def skip(name: str, start: int, found: str) -> int:
        """Where the end tag of name begins, or is over; the page's end if there is none."""
        if name in endless:
            return len(page)
        stop = re.compile(found, re.I).search(page, start)
        if stop is None:
            endless.add(name)
            return len(page)
        return stop.start()

    while m := _TOKEN.search(page, at, limit):
        put(page[at : m.start()])
        at = m.end()
        end, name, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if end else 1
            linked.append(" ")
        elif name == "br":
            put(" ")
        if name in BLOCK:
            close()
            in_link = 0
            heading = not end and name[0] == "h" and name[1:].isdigit()
        if end:
            if name in HOLDER and any(s[0] == name for s in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in RAW:
            at = skip(name, at, rf"</{name}")
        elif name in HOLDER or "hidden" in raw or "none" in raw:
            a = _attributes(raw)
            if name in HOLDER:
                silent, framed, article, hint, around = state()
                said = _CAMEL.sub("-", " ".join((a.get("class", ""), a.get("id", ""), a.get("role", "")))).lower()
                framed = framed or name in FRAME or (name == "header" and not article) or (name not in ("body", "article", "main") and a.get("role", "").lower() in ROLES)
                if name in ("article", "main"):
                    hint = -1
                elif name != "body" and (STRONG if article else HINT).search(said):
                    hints.append([around, 0])
                    hint = around = len(hints) - 1
                stack.append((name, silent or name in SILENT or _hidden(a), framed, article or name in ("article", "main"), hint, around))
            elif name in BLOCK and name != "hr" and _hidden(a):  # a hidden paragraph or heading lasts to its end tag
                stop = skip(name, at, rf"</{name}\s*>")
                at = stop if stop < len(page) else at
    put(page[at:])
    close()
    return [Block(*b[:6], 1 - hints[b[6]][1] / (in_articles if b[5] else words) if b[6] >= 0 and (in_articles if b[5] else words) else 0.0) for b in out]


def shapes(rows: list[tuple[int, int, bool, bool]]) -> np.ndarray:
    """The features of a page's blocks (words, words in links, heading, mark): each one's own, its neighbours', and the unlinked words of NEAR blocks on each side."""
    n = len(rows)
    if not n:
        return np.empty((0, len(FEATURES)))
    words, linked, heading, mark = (np.array([r[k] for r in rows], float) for k in range(4))
    links = linked / words
    pad = lambda v, k: np.concatenate([[0.0] * max(k, 0), v, [0.0] * max(-k, 0)])[max(-k, 0) : max(-k, 0) + n]
    near = sum(pad(words - linked, k) for k in range(-NEAR, NEAR + 1) if k)
    return np.stack([words, links, pad(words, 1), pad(links, 1), pad(words, -1), pad(links, -1), heading, pad(heading, 1), pad(heading, -1), near, mark], 1)


def features(found: list[Block]) -> np.ndarray:
    return shapes([(b.words, b.linked, b.heading, bool(_MARK.match(b.text) or _MARK.search(b.text[-60:]))) for b in found])


#: The labelled table: block shapes of small pages in order. a: all links, t: text (after a slash: words in links), h: heading,
#: c: copyright line; then the words; + for main text.
LABELLED = (
    "a1 a1 a2 a1 a1 a1 t9 h8+ t8+ t40+ t6+ t90+ t35+ t3+ c14",
    "a1 a2 a1 t5 h4+ t120+ t60/4+ t18+ t75+ c9",
    "a2 a1 h5+ t50+ t30+ t110/12+ t12+",
    "a1 a1 a1 t16 h9+ t4+ t22+ t5+ t14+ c20",
    "a1 a1 a1 a1 t20 h3+ t3+ t7+ c17",
    "a1 a2 a3 a2 a1 a2 h3+ t25+ t12+ h4+ t45+ t7+ t9+ t60/6+ h2+ t33+ a2 a3 c8",
    "a1 a1 h7+ t70+ a4+ t55+ t40+ h2 a6 a7 a5 c12",
    "h6+ t80+ t45+ t20+ h2 a8 a7 a9 a6 c6",
    "a1 a1 h5+ t60+ t85+ h2 a2 t14 a1 a2 t22 a1 a2 t9 a1 c7",
    "a1 a1 h3+ t6+ c10",
    "h2+ t4+ t5+",
    "t40+ t70+ t9+",
    "t6+",
    "t12 a2 h5+ t66+ t48+ a1 a1 a1 t8 c9",
    "t10/9 t14/12 h6+ t30/2+ t50+ t12/11 t25/22",
    "a3 a1 t30+ t50+ t6+ t44+ a1 a1 a2 t10 c12",
    "h4+ t60+ t20+ a3 t8 a2",
    "a1 a1 t11 h6+ h4+ t25+ t80+ h3+ t5+ t5+ t4+ t28+ c5",
    "t7 h5+ t60+ t38+ t52+ c18",
    "a1 a1 a1 t13 h10+ t12+ t2+ c13",
    "a1 a2 t4 h6+ t21+ t50+ t8+ c11",
    "a1 a1 a1 t6 h9+ t70+ t5+ t32+ c16",
)


def labelled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and labels of the table's blocks, and the page that each is of."""
    x, y, page = [], [], []
    for k, line in enumerate(LABELLED):
        found = re.findall(r"([atch])(\d+)(?:/(\d+))?(\+?)", line)
        x.append(shapes([(int(n), int(n) if kind == "a" else int(some or 0), kind == "h", kind == "c") for kind, n, some, _ in found]))
        y += [float(main == "+") for *_, main in found]
        page += [k] * len(found)
    return np.concatenate(x), np.array(y), np.array(page)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2) -> tuple:
    """A CART tree by Gini impurity: (feature, threshold, left, right) or (share of main text,). Ties: first feature, lowest threshold."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        for low, high in zip(v := np.unique(x[:, f]), v[1:], strict=False):
            left = x[:, f] <= (t := (low + high) / 2)
            n, k = left.sum(), len(y) - left.sum()
            if min(n, k) >= least:
                p, q = y[left].mean(), y[~left].mean()
                score = n * p * (1 - p) + k * q * (1 - q)
                if best is None or score < best[0] - 1e-12:
                    best = (score, f, t, left)
    if best is None or best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return (float(y.mean()),)
    _, f, t, left = best
    return (f, float(t), grow(x[left], y[left], depth - 1, least), grow(x[~left], y[~left], depth - 1, least))


def trained() -> tuple:
    x, y, _ = labelled()
    return grow(x, y)


def is_main(tree: tuple, row: np.ndarray) -> bool:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0] >= 0.5


def main_blocks(page: str | None, tree: tuple) -> list[str]:
    """The texts that the tree takes for main text, after the markup's own statements.

    The tree knows only shapes. What it says is corrected where the markup says so itself: frame elements (menus,
    headers and footers of the page, sidebars, forms) and small boxes named as such hold no main text, and unlinked text
    of an article element is main text.
    """
    found = blocks(page)
    has_article = any(b.article and not b.framed for b in found)
    out = []
    for b, row in zip(found, features(found), strict=True):
        out_of_text = b.framed or b.boxed >= BOX or (b.boxed > 0 and has_article and not b.article)
        if not out_of_text and (is_main(tree, row) or (b.article and 2 * b.linked < b.words)):
            out.append(b.text)
    return out


def _extract(tree: tuple):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ["\n\n".join(main_blocks(p, tree)) for p in texts(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for each row: the main blocks' texts in page order, joined by two newlines.

    Character references are decoded and white space inside a block becomes one space. A null or empty page, and one
    without main text, has an empty text. Equal rows give equal rows, ids and urls may be null, an empty table gives
    none, other columns are not read. Pages are worked on one by one in slices of bounded size, so a task holds a few
    MB, or its longest page.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_arrow(slim, _extract(trained()), "page_id long, url string, text string, n_chars long")
