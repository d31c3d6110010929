"""Older Office files, drawings, charts, recognisers and the command line."""

import http.server
import io
import json
import struct
import sys
import threading
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow import cli
from folioflow.functions import office
from folioflow.operators import pages, recognise
from folioflow.plans import legacy_plans, made_files
from folioflow.sources import charts, drawings, files, formulas, legacy, office_files, remote
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(legacy_plans.SQL))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, legacy_plans.QUERIES[name], legacy_plans.SQL[name], SF)


def test_streams_of_all_sizes():
    said = {"a": b"x" * 63, "b": bytes(range(256)) * 40, "c": b""}
    file = legacy.Compound(made_files.compound(said))
    assert {n: file.stream(n) for n in said} == said and file.stream("d") is None


def test_strings_over_several_records():
    text = "Größe 客户 " * 20
    whole = struct.pack("<II", 3, 3) + made_files.biff_string(text)
    cut = 8 + 3 + 40  # inside the characters, which go on in the narrow form
    rest = text[20:26]
    narrow = struct.pack("<HB", 20 + len(rest), 1) + text[:20].encode("utf-16-le")
    rich = struct.pack("<HBHI", 2, 13, 1, 3) + "ab".encode("utf-16-le") + b"RUNS" + b"ext"
    parts = [made_files.record(0x00FC, struct.pack("<II", 3, 3) + narrow), made_files.record(0x003C, b"\0" + rest.replace("客户", "xy").encode("latin-1") + rich), made_files.record(0x003C, whole[8:])]
    cells = [made_files.record(0x00FD, struct.pack("<HHHI", k, 0, 0, k)) for k in range(4)]
    (_, table) = legacy.workbook(made_files.compound({"Workbook": made_files.biff({"S": cells}, parts)}))
    assert cut == 51 and table.text.split("\n")[0] == f"| {(text[:20] + rest.replace('客户', 'xy')).strip()} |" and table.text.split("\n")[2:] == ["| ab |", f"| {text.strip()} |"]


def test_cells_of_all_kinds():
    r = made_files.record
    formula = lambda row, result: r(0x0006, struct.pack("<HHH", row, 1, 0) + result + bytes(8))
    cells = [
        r(0x0204, struct.pack("<HHH", 0, 0, 0) + made_files.biff_string("label")), r(0x0205, struct.pack("<HHHBB", 0, 1, 0, 1, 0)), r(0x0205, struct.pack("<HHHBB", 0, 2, 0, 42, 1)),
        r(0x00BD, struct.pack("<HH", 1, 0) + struct.pack("<HI", 2, 12345 << 2 | 3) + struct.pack("<HI", 0, 0x3FF80000) + struct.pack("<HI", 0, 0xFFFFFFFC | 2) + struct.pack("<H", 2)),
        formula(2, struct.pack("<d", 0.1 + 0.2)), formula(3, b"\0\0\0\0\0\0\xff\xff"), r(0x0207, made_files.biff_string("said")), formula(4, b"\x01\0\x01\0\0\0\xff\xff"), formula(5, b"\x02\0\x07\0\0\0\xff\xff"),
        r(0x0809, struct.pack("<HHHHII", 0x0600, 32, 0, 0, 0, 0)), r(0x0204, struct.pack("<HHH", 9, 9, 0) + made_files.biff_string("in a chart")), r(0x000A, b""),
    ]
    (_, table, empty) = legacy.workbook(made_files.compound({"Workbook": made_files.biff({"S": cells, "Empty": []}, [])}))
    assert [line.split(" | ") for line in table.text.split("\n")] == [
        ["| label", "TRUE", "#N/A |"], ["| ---", "---", "--- |"], ["| 12345.00%", "1.5", "-1 |"], ["| ", "0.3", " |"], ["| ", "said", " |"], ["| ", "TRUE", " |"], ["| ", "#DIV/0!", " |"],
    ]
    assert empty.text == "Empty"


def test_main_text_of_word_without_notes():
    data = made_files.old_document(["One \x13 HYPERLINK \x13 X \x15 \x14two\x15\x0bthree\r", "日本\f", "note\r"], main=5 + 22 + 7 + 3)
    assert [e.text for e in legacy.document(data)][-1] != "note"
    assert [e.text for e in legacy.document(made_files.old_document(["One \x13 A \x13 X \x15 \x14two\x15\x0bthree\r", "日本\f"]))] == ["One two", "three", "日本"]
    assert legacy.document(made_files.old_document([])) == []


def test_broken_compound_files(spark):
    good = made_files.old_workbook("n", "s", 1)
    loop = bytearray(good)
    struct.pack_into("<I", loop, 512 + 4, 1)  # the directory's sector follows itself
    bad = [b"", b"x" * 600, good[:700], bytes(loop), made_files.compound({"Other": b"x"}), made_files.old_document(["x"], flags=0x0100), made_files.compound({"Workbook": made_files.record(0x0809, struct.pack("<HHHHII", 0x0500, 5, 0, 0, 0, 0))})]
    for data in bad:
        with pytest.raises((ValueError, LookupError, struct.error)):
            legacy.workbook(data)
        with pytest.raises((ValueError, LookupError, struct.error)):
            legacy.document(data)
    rows = [(k, f"{k}.{'doc' if k % 2 else 'xls'}", bytearray(d)) for k, d in enumerate(bad)] + [(90, "a.dwg", bytearray(b"AC1032")), (91, "a.dxf", None), (92, "b.xls", bytearray(good))]
    elements, faults = files.read(spark.createDataFrame(rows, "doc_id long, path string, content binary"))
    assert faults.count() == len(bad) + 2 and {r.doc_id for r in elements.collect()} == {92}


def test_drawings():
    assert drawings.plain(r"{\fArial|b0|i0;A\~B}\PC \S1#2; \{x\} %%c5 \U+00B2 \\n") == "A B\nC 1/2 {x} Ø5 ² \\n"
    loop = b"0\nSECTION\n2\nBLOCKS\n0\nBLOCK\n2\nB\n0\nINSERT\n2\nB\n0\nENDBLK\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nINSERT\n2\nB\n0\nENDSEC\n"
    wide = b"0\nSECTION\n2\nHEADER\n9\n$DWGCODEPAGE\n3\nANSI_936\n0\nENDSEC\n0\nSECTION\n2\nENTITIES\n0\nTEXT\n1\n" + "图纸".encode("gbk") + b"\n0\nTEXT\n1\n \n0\nEOF\n"
    assert [e.text for e in drawings.drawing(wide)] == ["整图", "图纸"]
    assert drawings.drawing(wide.replace(b"9\n$DWG", b"9\n$ACADVER\n1\nAC1032\n9\n$DWG").replace("图纸".encode("gbk"), "图".encode()))[1].text == "图"
    assert [e.text for e in drawings.drawing(b"\xef\xbb\xbf999\r\nby hand\r\n0\r\nSECTION\r\n2\r\nENTITIES\r\n0\r\nENDSEC\r\n")] == ["整图"]
    pair = lambda code, value: struct.pack("<H", code) + value
    binary = drawings.BINARY + pair(0, b"SECTION\0") + pair(2, b"ENTITIES\0") + pair(0, b"TEXT\0") + pair(10, bytes(8)) + pair(62, bytes(2)) + pair(290, bytes(1)) + pair(310, b"\x02ab") + pair(1, b"said\0") + pair(0, b"EOF\0")
    assert [e.text for e in drawings.drawing(binary)] == ["整图", "said"]
    for bad in (b"", b"hello", b"AC1015xx", loop, b"0\nSECTION\nx\ny\n"):
        with pytest.raises(ValueError):
            drawings.drawing(bad)


def test_charts(spark):
    scatter = b'<c><scatterChart><ser><xVal><pt idx="0"><v>1</v></pt></xVal><yVal><pt idx="0"><v>2</v></pt></yVal></ser></scatterChart></c>'
    assert charts.parse(scatter) == ("scatter_chart", "", [["X", "系列 1"], ["1", "2"]])
    assert charts.parse(b"<c><pieChart/></c>") == ("pie_chart", "", []) and charts.parse(b"<c/>") is None and charts.elements(b"<c/>") == []
    far = b'<c><pieChart><ser><val><pt idx="99999999"><v>1</v></pt></val></ser></pieChart></c>'
    with pytest.raises(ValueError):
        charts.parse(far)
    rows = [(k, bytearray(d) if d is not None else None, 1) for k, d in enumerate([scatter, None, b"", b"<x", far])]
    assert [r.doc_id for r in charts.charts(spark.createDataFrame(rows, "doc_id long, content binary, rows int")).collect()] == [0]


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_charts_inside_office_files():
    rels = lambda kind, target: f'<r><Relationship Id="r" Type="t/{kind}" Target="{target}"/></r>'
    part = made_files.chart("N", 2)
    word = archive({"word/document.xml": '<d xmlns:r="x"><body><p><r><t>before</t></r></p><p><r><drawing><chart r:id="r"/></drawing></r></p><p><r><drawing><chart r:id="none"/></drawing></r></p></body></d>', "word/_rels/document.xml.rels": rels("chart", "c.xml"), "word/c.xml": part})
    assert [(e.label, e.text.split("\n")[0]) for e in office_files.document(word)] == [("text", "before"), ("caption", "Chart N"), ("table", "| 类别 | N | 系列 2 |")]
    sheet = {"xl/workbook.xml": '<w xmlns:r="x"><sheets><sheet name="S" r:id="r"/></sheets></w>', "xl/_rels/workbook.xml.rels": rels("worksheet", "s.xml"), "xl/s.xml": "<w><sheetData/></w>", "xl/_rels/s.xml.rels": rels("drawing", "d.xml")}
    book = archive(sheet | {"xl/d.xml": '<d xmlns:r="x"><chart r:id="r"/></d>', "xl/_rels/d.xml.rels": rels("chart", "c.xml"), "xl/c.xml": part})
    assert [e.label for e in office_files.workbook(book)] == ["section_header", "caption", "table"]
    assert [e.label for e in office_files.workbook(archive(sheet | {"xl/d.xml": '<d xmlns:r="x"><chart r:id="r"/></d>', "xl/_rels/d.xml.rels": rels("chart", "c.xml"), "xl/c.xml": "<x"}))] == ["section_header"]


def test_pages_are_asked_twice_at_most(spark):
    asked = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "��", "b"), (None, None, None, None)], "doc_id long, page_no long, existing string, answer_to string")
    hook = lambda page: (page["answer_to"] or "") if page["attempt"] == 2 and page["feedback"] == "empty" else None
    got = {r.page_no: (r.text, r.attempt, r.fault) for r in recognise.recognised(asked, hook).collect()}
    assert got == {1: ("a", 2, None), 2: ("b", 2, None), None: (None, 2, "empty")}
    assert recognise.recognised(asked.limit(0), hook).count() == 0
    assert {r.fault for r in recognise.recognised(asked, hook, attempts=1).collect()} == {"empty"}


def test_visual_answers(spark):
    asked = spark.createDataFrame([(k, 0.0, 0.0, "x") for k in range(4)], "page long, width double, height double, label string")
    good = {"label": "text", "text": "said", "level": 1, "confidence": 1, "l": 1, "t": 9, "r": 5, "b": 2}

    def hook(page):
        if page["page"] == 0:
            raise OSError
        return [None, "[]", "nothing", json.dumps([good, good | {"text": "more", "b": 10, "t": 19}])][page["page"]]

    items, faults = recognise.visual_items(asked, hook)
    assert sorted((r.page, r.ord, r.text) for r in items.collect()) == [(3, 0, "said"), (3, 1, "more")]
    got = {r.page: (r.attempt, r.fault) for r in faults.collect()}
    assert got[0] == (2, "failed") and got[1][0] == got[2][0] == 2 and None not in (got[1][1], got[2][1]) and 3 not in got
    assert recognise.visual_items(asked.limit(0), hook)[0].count() == 0


def test_formulas():
    from xml.etree import ElementTree

    latex = lambda inner: formulas.latex(ElementTree.fromstring(f'<m:oMath xmlns:m="m">{inner}</m:oMath>'))
    e = lambda text, tag="e": f"<m:{tag}><m:r><m:rPr>x</m:rPr><m:t>{text}</m:t></m:r></m:{tag}>"
    assert latex(f'<m:rad><m:radPr><m:degHide m:val="0"/></m:radPr>{e("3", "deg")}{e("x")}</m:rad>') == r"\sqrt[3]{x}"
    assert latex(f'<m:rad><m:radPr><m:degHide/></m:radPr>{e("3", "deg")}{e("x")}</m:rad>') == r"\sqrt{x}"
    assert latex(f'<m:d><m:dPr><m:begChr m:val="{{"/><m:endChr m:val="]"/><m:sepChr m:val="%"/></m:dPr>{e("a")}{e("b")}</m:d>') == r"\left\{a\%b\right]"
    assert latex(f"<m:m><m:mr>{e('1')}{e('2')}</m:mr><m:mr>{e('3')}{e('4')}</m:mr></m:m>") == r"\begin{matrix}1 & 2 \\ 3 & 4\end{matrix}"
    assert latex(f"<m:eqArr>{e('1')}{e('2')}</m:eqArr><m:func>{e('sin', 'fName')}{e('x')}</m:func>") == r"\begin{aligned}1 \\ 2\end{aligned}\operatorname{sin}{x}"
    assert latex(f'<m:bar><m:barPr><m:pos m:val="bot"/></m:barPr>{e("x")}</m:bar><m:acc>{e("y")}</m:acc><m:acc><m:accPr><m:chr m:val="→"/></m:accPr>{e("z")}</m:acc>') == r"\underline{x}\hat{y}\vec{z}"
    assert latex(f'<m:groupChr>{e("x")}</m:groupChr><m:groupChr><m:groupChrPr><m:pos m:val="top"/></m:groupChrPr>{e("y")}</m:groupChr><m:borderBox>{e("b")}</m:borderBox>') == r"\underbrace{x}\overbrace{y}\boxed{b}"
    assert latex(f"<m:sPre>{e('1', 'sub')}{e('2', 'sup')}{e('X')}</m:sPre><m:nary>{e('0', 'sub')}{e('x')}</m:nary>") == r"{}_{1}^{2}{X}\int_{0}{x}"
    assert latex("") == "" and latex("<m:e>" * 80 + "<m:t>deep_</m:t>" + "</m:e>" * 80) == "deep_"


def test_merged_meta_of_nothing(spark):
    rows = spark.createDataFrame([(None, None), ({}, None), ({"a": "1"}, {"a": None}), ({"a": None}, {"b": ""}), (None, {"a": "2"})], "x map<string,string>, y map<string,string>")
    assert [r[0] for r in rows.select(office.merged_meta(F.col("x"), F.col("y"))).collect()] == [None, "{}", '{"a":1}', "{}", '{"a":2}']


class Service(http.server.BaseHTTPRequestHandler):
    calls: dict = {}

    def do_GET(self):
        self.send_response(200 if self.path == "/health" else 404)
        self.end_headers()

    def do_POST(self):
        body = self.rfile.read(int(self.headers["Content-Length"]))
        name = body.split(b'filename="')[1].split(b'"')[0].decode()
        n = self.calls[name] = self.calls.get(name, 0) + 1
        self.send_response(200 if name != "late" or n > 1 else 500)
        self.end_headers()
        tree = {"body": {"children": [{"$ref": "#/texts/0"}]}, "texts": [{"label": "text", "text": body.split(b"octet-stream\r\n\r\n")[1].split(b"\r\n--")[0].decode()}]}
        self.wfile.write(json.dumps({"status": "failure" if name == "bad" else "success", "document": {"json_content": tree}}).encode())

    def log_message(self, *args):
        pass


def test_remote_service(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    rows = [(1, "good", bytearray(b"text of one")), (2, "late", bytearray(b"two")), (3, "bad", bytearray(b"x")), (4, "empty", None), (None, None, bytearray(b"five"))]
    elements, faults = remote.read(spark.createDataFrame(rows, "doc_id long, path string, content binary"), url, wait=0.01)
    assert sorted((str(r.doc_id), r.label, r.text) for r in elements.collect()) == [("1", "text", "text of one"), ("2", "text", "two"), ("None", "text", "five")]
    assert Service.calls["late"] == 2 and Service.calls["bad"] == 3
    assert {r.doc_id for r in faults.collect()} == {3, 4}
    assert remote.healthy(url) and not remote.healthy(url + "none")
    server.shutdown()
    server.server_close()
    assert not remote.healthy(url, timeout=1)
    with pytest.raises(ValueError):
        remote.convert(url, "x", b"x", retries=1, timeout=1, wait=0)


def test_places_beyond_a_table(spark):
    cells = spark.createDataFrame([(1, 0, -1, 9, 0, 9, "a"), (1, 1, 1, 2, 1, 2, None), (2, 0, 5, 6, 5, 6, "out")], "t long, idx long, r0 long, r1 long, c0 long, c1 long, text string")
    sizes = spark.createDataFrame([(1, 2, 2), (2, 1, 1), (3, 0, 5)], "t long, rows long, cols long")
    got = sorted(tuple(r) for r in pages.grid_places(cells, sizes, ["t"]).select("t", "r", "c", F.coalesce("idx", F.lit(-1)), "text").collect())
    assert got == [(1, 0, 0, 0, "a"), (1, 0, 1, 0, "a"), (1, 1, 0, 0, "a"), (1, 1, 1, 1, ""), (2, 0, 0, -1, "")]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    source = tmp_path / "x.md"
    source.write_text("# T\n\nintro\n\n## A\n\nalpha\n\n## B\n\n| k | v |\n| --- | --- |\n| 1 | 2 |\n")
    run = lambda *args: (cli.main(["parse", *args], spark), capsys.readouterr())
    code, said = run(str(source))
    assert code == 0 and said.out == "文档: x.md | 5 文本块 | 1 表格 | 0 图片\n\n标题树:\n  - T\n    - A\n    - B\n\n表格:\n  #1 2行x2列 (T / B)\n"
    assert run(str(source), "--format", "md", "--section", "A")[1].out.strip() == "## A\n\nalpha"
    assert run(str(source), "--format", "md")[1].out.startswith("# T\n\nintro")
    assert [i["type"] for i in json.loads(run(str(source), "--format", "content-list", "--section", "B")[1].out)] == ["text", "table"]
    target = tmp_path / "out.json"
    code, said = run(str(source), "--format", "json", "--section", "A", "--out", str(target))
    assert code == 0 and said.out == "" and "don't apply" in said.err and json.loads(target.read_text())["texts"][0]["text"] == "T"
    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(b"k,v\n1,2\n")}))
    assert run("-")[0] == 1
    code, said = run("-", "--name", "t.csv", "--format", "md")
    assert code == 0 and said.out == "| k | v |\n| --- | --- |\n| 1 | 2 |\n"
    assert run(str(tmp_path / "none.md"))[0] == run("-", "--name", "x.unknown")[0] == 1
    with pytest.raises(SystemExit):
        cli.main([])
