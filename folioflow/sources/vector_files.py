"""Vector images and model files as elements."""

from __future__ import annotations

import base64
import json
import re
import struct
from collections import deque
from collections.abc import Iterator
from xml.etree import ElementTree

from folioflow.sources.elements import Element

#: The size of an image that states none, what it may not hold, its longest data URI, and units in CSS pixels.
SVG_SIZE = (300.0, 150.0)
UNSAFE = ("script", "foreignObject")
MAX_URI = 8 << 20
UNITS = {"": 1.0, "px": 1.0, "pt": 96 / 72, "in": 96.0, "cm": 96 / 2.54, "mm": 96 / 25.4, "pc": 16.0}

_LENGTH = re.compile(r"\s*\+?(\d+(?:\.\d*)?|\.\d+)(e[+-]?\d+)?\s*(px|pt|in|cm|mm|pc|)\s*$", re.I)


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def css_pixels(length: str) -> float | None:
    """A length in CSS pixels; None for percentages, units relative to a font, negative and broken ones."""
    m = _LENGTH.match(length)
    return float(m[1] + (m[2] or "")) * UNITS[m[3].lower()] if m else None


def vector_size(attributes: dict[str, str]) -> tuple[float, float]:
    """Width and height of an image's root, those of the view box where it states none."""
    a = {_local(k).lower(): v for k, v in attributes.items()}
    size = [css_pixels(a.get(k, "")) or 0.0 for k in ("width", "height")]
    box = a.get("viewbox", "").split()
    if min(size) <= 0 and len(box) == 4:
        size = [css_pixels(v) or 0.0 for v in box[2:]]
    return (size[0], size[1]) if min(size) > 0 else SVG_SIZE


def _safe(node: ElementTree.Element) -> None:
    for attribute, value in list(node.attrib.items()):
        name = _local(attribute).lower()
        if name.startswith("on") or (name == "href" and not value.strip().startswith("#")):
            del node.attrib[attribute]
    for k, child in reversed(list(enumerate(node))):
        if _local(child.tag) in UNSAFE:
            tail, node[k:k + 1] = child.tail or "", []
            if k:
                node[k - 1].tail = (node[k - 1].tail or "") + tail
            else:
                node.text = (node.text or "") + tail
        else:
            _safe(child)


def _said(node: ElementTree.Element) -> Iterator[tuple[str, str]]:
    """(name, text) of the outermost title, desc and text elements."""
    for child in node:
        name = _local(child.tag)
        if name in ("title", "desc", "text"):
            yield name, "".join(child.itertext()).strip()
        else:
            yield from _said(child)


def vector_image(data: bytes) -> list[Element]:
    """Title, description and texts of an SVG image, and the image itself without scripts, event attributes and outside references."""
    root = ElementTree.fromstring(data)
    if _local(root.tag) != "svg":
        raise ValueError(f"root element {_local(root.tag)} instead of svg")
    _safe(root)
    said = [(n, t) for n, t in _said(root) if t]
    first = lambda name: [t for n, t in said if n == name][:1]
    out = [Element("title", t) for t in first("title")] + [Element("caption", t) for t in first("desc")] + [Element("text", t) for n, t in said if n == "text"]
    for prefix, uri in (("", "http://www.w3.org/2000/svg"), ("xlink", "http://www.w3.org/1999/xlink")):
        ElementTree.register_namespace(prefix, uri)
    clean = ElementTree.tostring(root)
    if len(clean) <= MAX_URI:
        out.append(Element("picture", "data:image/svg+xml;base64," + base64.b64encode(clean).decode()))
    return out


#: Fixed values of the container: its mark, version and kinds of chunks; limits of its metadata.
GLB_MARK, GLB_VERSION, GLB_JSON, GLB_BINARY = b"glTF", 2, 0x4E4F534A, 0x004E4942
MAX_MODEL_JSON, MAX_MODEL_NODES = 16 << 20, 100_000
#: Fixed phrases of the elements of a model file.
MODEL_HEADING = "三维模型信息"
MODEL_SUMMARY = "格式：GLB / glTF {}；场景：{}；节点：{}；网格：{}；渲染材质：{}"
MODEL_TOOL, MODEL_RIGHTS = "生成工具：", "版权信息："
MODEL_NOTE = "本解析结果提取模型结构与已有属性，不包含几何渲染或工程材料推断。"
MODEL_EXTENSIONS = "模型声明必需扩展：{}；此处仅保留元数据，未解码扩展几何。"
MODEL_SOURCE, MODEL_PROPERTY = "模型来源：", "自定义属性（{}/{}）："
MODEL_ROOTS, MODEL_PARENT, MODEL_CHILDREN, MODEL_MESH = "根节点：", "父节点：", "子节点：", "引用网格："
MODEL_PRIMITIVES, MODEL_PRIMITIVE = "图元数量：{}", "图元[{}] 渲染材质：{}"
MODEL_KINDS = {"scenes": "场景", "nodes": "节点", "meshes": "网格", "materials": "渲染材质"}
MODEL_COMMA = "、"

_SPACE = re.compile(r"[ \t\r\n]*")


def _members(text: str) -> Iterator[tuple[str | int, str]]:
    """(key, text as written) of a JSON object's members, or (place, text) of an array's: numbers keep all their digits."""
    decode = json.JSONDecoder().raw_decode
    skip = lambda at: _SPACE.match(text, at).end()
    at = skip(0)
    named = text[at:at + 1] == "{"
    at, place = skip(at + 1), 0
    while text[at] not in "}]":
        key: str | int = place
        if named:
            key, at = decode(text, at)
            at = skip(skip(at) + 1)
        end = decode(text, at)[1]
        yield key, text[at:end]
        at, place = skip(end), place + 1
        if text[at] == ",":
            at = skip(at + 1)


def model_metadata(data: bytes) -> str:
    """The JSON of a binary glTF 2.0 file, whose container must be whole: chunks of full length, JSON first and once, binary data second."""
    if len(data) < 20 or len(data) % 4 or struct.unpack("<4sII", data[:12]) != (GLB_MARK, GLB_VERSION, len(data)):
        raise ValueError("head of a model file")
    at, chunks = 12, []
    while at < len(data):
        size, kind = struct.unpack("<II", data[at:at + 8].ljust(8, b"\xff"))
        if size % 4 or at + 8 + size > len(data):
            raise ValueError("chunk of a model file")
        chunks.append((kind, at + 8, size))
        at += 8 + size
    kinds = [kind for kind, _, _ in chunks]
    if kinds[0] != GLB_JSON or GLB_JSON in kinds[1:] or GLB_BINARY in kinds[2:] or chunks[0][2] > MAX_MODEL_JSON:
        raise ValueError("order of a model file's chunks")
    return data[chunks[0][1]:chunks[0][1] + chunks[0][2]].decode().rstrip(" \0")


def _parents(model: dict, counts: dict[str, int]) -> dict[int, int]:
    """Each node's parent. References must exist, a node has one parent at most, and no node is below itself."""
    within = lambda k, kind: isinstance(k, int) and 0 <= k < counts[kind]
    nodes = model.get("nodes") or []
    edges = [(child, k) for k, n in enumerate(nodes) for child in n.get("children") or []]
    parents = dict(edges)
    uses = [(n["mesh"], "meshes") for n in nodes if "mesh" in n] + [(c, "nodes") for c, _ in edges] + [(model[k], "scenes") for k in ("scene",) if k in model]
    uses += [(p["material"], "materials") for m in model.get("meshes") or [] for p in m.get("primitives") or [] if "material" in p]
    roots = [r for s in model.get("scenes") or [] for r in s.get("nodes") or []]
    if len(nodes) > MAX_MODEL_NODES or len(parents) < len(edges) or not all(within(*u) for u in uses) or any(not within(r, "nodes") or r in parents for r in roots):
        raise ValueError("references of a model file")
    open_, seen = deque(k for k in range(len(nodes)) if k not in parents), 0
    while open_:
        seen += 1
        open_.extend(nodes[open_.popleft()].get("children") or [])
    if seen < len(nodes):
        raise ValueError("cycle of a model file's nodes")
    return parents


def _properties(raw: str, pointer: str) -> Iterator[Element]:
    fields = dict(_members(raw))
    for field in ("extras", "extensions"):
        value, head = fields.get(field, "null"), MODEL_PROPERTY.format(pointer, field)
        if value.startswith("{"):
            yield from (Element("text", f"{head}{k} = {v}") for k, v in sorted(dict(_members(value)).items()))
        elif value != "null":
            yield Element("text", head + value)


def model_file(data: bytes) -> list[Element]:
    """What a binary glTF 2.0 file says of itself: a section for each scene, node, mesh and material with its references and own properties."""
    text = model_metadata(data)
    model = json.loads(text)
    asset = model.get("asset") or {}
    if asset.get("version") != "2.0" or asset.get("minVersion") not in (None, "", "2.0"):
        raise ValueError("version of a model file")
    counts = {kind: len(model.get(kind) or []) for kind in MODEL_KINDS}
    parents = _parents(model, counts)
    called = lambda kind, k: f"{MODEL_KINDS[kind]}[{k}] {model[kind][k].get('name', '')}".strip()
    all_called = lambda ks: MODEL_COMMA.join(called("nodes", k) for k in ks)
    raw = dict(_members(text))

    lines = [MODEL_SUMMARY.format(asset["version"], *counts.values()), *(head + asset[key] for key, head in (("generator", MODEL_TOOL), ("copyright", MODEL_RIGHTS)) if asset.get(key)), MODEL_NOTE]
    if model.get("extensionsRequired"):
        lines.append(MODEL_EXTENSIONS.format(MODEL_COMMA.join(model["extensionsRequired"])))
    out = [Element("section_header", MODEL_HEADING, level=1), *(Element("text", line) for line in lines), *_properties(text, "#"), *_properties(raw["asset"], "#/asset")]
    for kind in MODEL_KINDS:
        for k, own in _members(raw.get(kind, "[]")) if counts[kind] else ():
            thing, pointer = model[kind][k], f"#/{kind}/{k}"
            lines = [MODEL_SOURCE + pointer]
            if kind == "scenes":
                lines.append(MODEL_ROOTS + all_called(thing.get("nodes") or []))
            if k in parents and kind == "nodes":
                lines.append(MODEL_PARENT + called("nodes", parents[k]))
            if kind == "nodes" and thing.get("children"):
                lines.append(MODEL_CHILDREN + all_called(thing["children"]))
            if kind == "nodes" and "mesh" in thing:
                lines.append(MODEL_MESH + called("meshes", thing["mesh"]))
            if kind == "meshes":
                parts = thing.get("primitives") or []
                lines += [MODEL_PRIMITIVES.format(len(parts)), *(MODEL_PRIMITIVE.format(j, called("materials", p["material"])) for j, p in enumerate(parts) if "material" in p)]
            out += [Element("section_header", called(kind, k), level=2), *(Element("text", line) for line in lines), *_properties(own, pointer)]
    return out
