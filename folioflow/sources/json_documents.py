"""Documents in JSON as elements: trees of items that name each other by references."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from folioflow.sources import elements, grids
from folioflow.sources.elements import Element

#: The arrays of items, and the legacy form of heading labels.
KINDS = ("texts", "tables", "pictures", "groups", "key_value_items", "form_items")
_HEADING = re.compile(r"heading[-_ ]*(\d+)$", re.I)


def _target(ref) -> str:
    return ref.get("$ref") or ref.get("cref") or "" if isinstance(ref, dict) else str(ref)


def _item(document: dict, ref: str) -> dict | None:
    kind, _, idx = ref.removeprefix("#/").partition("/")
    items = document.get(kind) or []
    return items[int(idx)] if kind in KINDS and idx.isdecimal() and int(idx) < len(items) else None


def _table(data: dict) -> str:
    cells = []
    for c in data.get("table_cells") or []:
        row, col = c.get("start_row_offset_idx") or 0, c.get("start_col_offset_idx") or 0
        down, across = ((c.get(f"end_{x}_offset_idx") or at + (c.get(f"{x}_span") or 1)) - at for x, at in (("row", row), ("col", col)))
        cells.append(grids.Cell(row, col, down, across, bool(c.get("column_header")), bool(c.get("row_header")), c.get("text") or ""))
    cells += [grids.Cell(y, x, 1, 1, False, False, (c or {}).get("text") or "") for y, row in enumerate(data.get("grid") or []) for x, c in enumerate(row)] if not cells else []
    if any(not 0 <= v <= grids.MAX_SPAN for c in cells for v in (c.row, c.col, c.row_span, c.col_span)):
        raise ValueError("place of a table's cell")
    rows, cols = (max((getattr(c, a) + getattr(c, b) for c in cells), default=0) for a, b in (("row", "row_span"), ("col", "col_span")))
    reach = [grids.Cell(max(rows, data.get("num_rows") or 0) - 1, max(cols, data.get("num_cols") or 0) - 1, 1, 1, False, False, "")] if cells else []
    return elements.gfm(grids.filled(reach + cells))


def _element(kind: str, item: dict, layer: str, lists: int) -> Element | None:
    label, text = item.get("label") or "", item.get("text") or item.get("orig") or ""
    legacy = _HEADING.match(label)
    meta = item.get("meta") or {}
    if kind == "tables":
        return Element("table", _table(item.get("data") or {}), layer=layer)
    if kind == "pictures":
        return Element("picture", (item.get("image") or {}).get("uri") or "", layer=layer)
    if kind != "texts":
        return None
    if legacy or label == "section_header":
        return Element("section_header", text, level=max(int(legacy[1]) if legacy else item.get("level") or 1, 1), layer=layer)
    if label == "list_item":
        return Element(label, text, depth=meta.get("depth") or max(lists - 1, 0), layer=layer, marker=item.get("marker") or "")
    if label == "formula":
        return Element(label, text or item.get("latex") or "", layer=layer)
    return Element(label or "text", text, layer=layer, language=item.get("code_language") or "")


def _walk(document: dict, root: str, layer: str, seen: set[str]) -> Iterator[Element]:
    """The items below a root, each where it is met first: itself, what is below it, and its captions."""
    todo = [(ref, layer, 0) for ref in reversed(list(map(_target, (document.get(root) or {}).get("children") or [])))]
    while todo:
        ref, above, lists = todo.pop()
        item = _item(document, ref)
        if item is None or ref in seen:
            continue
        seen.add(ref)
        kind = ref.split("/")[1]
        own = item.get("content_layer") or above
        said = _element(kind, item, own, lists)
        if said is not None and (said.text.strip() or said.label == "picture"):
            yield said
        below = [_target(r) for key in ("children", "captions") for r in item.get(key) or []]
        deeper = lists + (kind == "groups" and item.get("label") in ("list", "ordered_list"))
        todo += [(r, own, deeper) for r in reversed(below)]


def parse(text: str) -> list[Element]:
    """The body's elements and then the furniture's. JSON within a JSON string is read too; references to nothing are left out, cycles end."""
    document = json.loads(text) if text.strip() else {}
    if isinstance(document, str):
        document = json.loads(document)
    if not isinstance(document, dict):
        raise ValueError("no object")
    seen: set[str] = set()
    return [e for root in ("body", "furniture") for e in _walk(document, root, root, seen)]
