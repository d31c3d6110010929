"""Tables of pages, vector images and model files."""

import base64
import json
import struct

import pytest

from folioflow.sources import html_pages, html_tables, vector_files


def test_spans_put_cells_in_their_places():
    found = html_tables.parse("<table><tr><th>k<th colspan=2>v<tr><th rowspan=2>1<td>2<td>3<tr><td>4<td>5</table>")
    assert [[tuple(c) for c in t] for t in found] == [[
        (0, 0, 1, 1, True, False, "k"), (0, 1, 1, 2, True, False, "v"), (1, 0, 2, 1, False, True, "1"), (1, 1, 1, 1, False, False, "2"), (1, 2, 1, 1, False, False, "3"),
        (2, 1, 1, 1, False, False, "4"), (2, 2, 1, 1, False, False, "5"),
    ]]
    assert html_pages.parse("<table><tr><th>k<th colspan=2>v<tr><th rowspan=2>1<td>2<td>3<tr><td>4<td>5</table>")[0].text == "| k | v | v |\n| --- | --- | --- |\n| 1 | 2 | 3 |\n| 1 | 4 | 5 |"


def test_headers_that_reach_down_share_a_row():
    (found,) = html_tables.parse("<table><tr><th rowspan=2>a</tr><tr><td>x<td>y</table>")
    assert [tuple(c)[:4] for c in found] == [(0, 0, 1, 1), (0, 1, 1, 1), (0, 2, 1, 1)]


def test_hard_tables():
    assert html_tables.parse("") == [] and html_tables.parse("<table></table>") == [] and html_tables.parse("<td>x<tr>") == []
    (found,) = html_tables.parse("<table><tr hidden><td hidden>a<td colspan=99999999>b<td rowspan=x>c")
    assert [(c.col, c.col_span, c.row_span, c.text) for c in found] == [(0, 1, 1, ""), (1, 4096, 1, "b"), (4097, 1, 1, "c")]
    assert html_tables.parse("<div hidden><table><tr><td>x</table></div>") == []


def test_cells_of_null_pages(spark):
    pages = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "<table><tr><td>x</table>", 7)], "page_id long, html string, col int")
    assert [(r.doc_id, r.text) for r in html_tables.cells(pages).collect()] == [(3, "x")]
    assert html_tables.cells(pages.limit(0)).count() == 0


def test_vector_sizes():
    size = vector_files.vector_size
    assert size({"width": "2in", "height": "72pt"}) == (192.0, 96.0) and size({"width": "50%", "height": "9", "viewBox": "0 0 30 40"}) == (30.0, 40.0)
    assert size({}) == size({"width": "-1", "height": "x"}) == vector_files.SVG_SIZE and round(size({"width": "2.54cm", "height": "25.4mm"})[0], 6) == 96


def test_vector_images_lose_what_acts():
    found = vector_files.vector_image(b'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" onload="f()">a<script>1</script>b<a xlink:href="http://q"/><use xlink:href=" #k"/><desc>D</desc><title/><title>T</title></svg>')
    assert [(e.label, e.text) for e in found[:2]] == [("title", "T"), ("caption", "D")]
    clean = base64.b64decode(found[2].text.partition(",")[2]).decode()
    assert "script" not in clean and "onload" not in clean and "http://q" not in clean and ">ab<" in clean and "#k" in clean
    with pytest.raises(ValueError):
        vector_files.vector_image(b"<html/>")


def model(content, size=None, extra=b""):
    text = content if isinstance(content, bytes) else json.dumps(content).encode()
    text += b" " * (-len(text) % 4)
    return struct.pack("<4sII", b"glTF", 2, size or 20 + len(text) + len(extra)) + struct.pack("<II", len(text), vector_files.GLB_JSON) + text + extra


def test_model_properties_keep_their_digits():
    found = vector_files.model_file(model(b'{"asset": {"version": "2.0", "extras": 12345678901234567890.10}, "extensions": {"b": [1, 2], "a": {"c" :null}}, "extensionsRequired": ["x", "y"]}'))
    assert [e.text for e in found[3:]] == ["模型声明必需扩展：x、y；此处仅保留元数据，未解码扩展几何。", '自定义属性（#/extensions）：a = {"c" :null}', "自定义属性（#/extensions）：b = [1, 2]", "自定义属性（#/asset/extras）：12345678901234567890.10"]


@pytest.mark.parametrize(
    "data",
    [
        b"", model({"asset": {"version": "1.0"}}), model({"asset": {"version": "2.0"}}, size=99), model({"asset": {"version": "2.0"}}, extra=struct.pack("<II", 0, vector_files.GLB_JSON)),
        model({"asset": {"version": "2.0"}, "nodes": [{"children": [0]}]}), model({"asset": {"version": "2.0"}, "nodes": [{"children": [2]}, {"children": [2]}, {}]}),
        model({"asset": {"version": "2.0"}, "nodes": [{"mesh": 0}]}), model({"asset": {"version": "2.0"}, "scenes": [{"nodes": [1]}], "nodes": [{"children": [1]}, {}]}),
    ],
)
def test_broken_models(data):
    with pytest.raises(ValueError):
        vector_files.model_file(data)


def test_json_documents():
    from folioflow.sources import json_documents

    text = {"label": "text", "text": "a", "children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/texts/99"}, {"$ref": "#/pages/0"}]}
    items = {
        "body": {"children": [{"$ref": f"#/texts/{k}"} for k in range(3)] + [{"$ref": "#/tables/0"}, {"$ref": "#/tables/1"}]}, "furniture": {"children": [{"$ref": "#/texts/3"}]},
        "texts": [text, {"label": "heading-3", "text": "h"}, {"label": "formula", "text": "", "latex": "x"}, {"label": "text", "orig": "foot"}, {"label": "list_item", "text": "i", "marker": "1."}, {"label": "caption", "text": "c"}],
        "groups": [{"label": "list", "children": [{"$ref": "#/groups/1"}]}, {"label": "list", "children": [{"$ref": "#/texts/4"}]}],
        "tables": [{"captions": [{"$ref": "#/texts/5"}], "data": {"num_cols": 3, "table_cells": [{"text": "w", "start_row_offset_idx": 0, "end_row_offset_idx": 1, "start_col_offset_idx": 0, "end_col_offset_idx": 2}]}}, {"data": {"grid": [[{"text": "g"}]]}}],
    }
    found = json_documents.parse(json.dumps(json.dumps(items)))
    assert [(e.label, e.text, e.level, e.depth, e.layer) for e in found] == [
        ("text", "a", 0, 0, "body"), ("list_item", "i", 0, 1, "body"), ("section_header", "h", 3, 0, "body"), ("formula", "x", 0, 0, "body"), ("table", "| w | w |  |\n| --- | --- | --- |", 0, 0, "body"),
        ("caption", "c", 0, 0, "body"), ("table", "| g |\n| --- |", 0, 0, "body"), ("text", "foot", 0, 0, "furniture"),
    ]
    assert json_documents.parse("") == json_documents.parse("{}") == []
    for bad in ("[1]", "{", json.dumps({"body": {"children": [{"$ref": "#/tables/0"}]}, "tables": [{"data": {"table_cells": [{"start_row_offset_idx": 10**9}]}}]})):
        with pytest.raises(ValueError):
            json_documents.parse(bad)


def test_trees_of_nothing(spark):
    from folioflow.operators import tree_json
    from folioflow.sources import elements, json_documents

    e = spark.createDataFrame([(1, 0, "table", 0, 0, None, None, None, None), (2, 0, "text", None, None, "furniture", "x", None, None), (2, 1, "picture", 0, 0, "body", "", "", "")], elements.SCHEMA)
    back = elements.read(tree_json.to_tree(e), json_documents.parse, text_col="json").collect()
    assert sorted((r.doc_id, r.ord, r.label, r.layer, r.text) for r in back) == [(2, 0, "picture", "body", ""), (2, 1, "text", "furniture", "x")]
    assert tree_json.to_tree(e.limit(0)).count() == 0
