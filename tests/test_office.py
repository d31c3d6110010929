"""Office files made here, page operators against plain Python, and the queries that have no SQL."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from folioflow.operators import office, pdf_pages
from folioflow.sources import files, office_files

RELS = '<Relationships xmlns="r">{}</Relationships>'


def rel(i, kind, target):
    return f'<Relationship Id="{i}" Type="http://x/{kind}" Target="{target}"/>'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def workbook():
    cell = lambda ref, text, kind="inlineStr": f'<c r="{ref}" t="{kind}">' + (f"<is><t>{text}</t></is>" if kind == "inlineStr" else f"<v>{text}</v>") + "</c>"
    one = "".join(cell(*x) for x in (("A1", "Sales"), ("A2", "year"), ("B2", "sum"), ("A3", "2020", "n"), ("B3", "0", "s"), ("E9", "alone")))
    return packed(**{
        "_rels/.rels": RELS.format(rel("a", "officeDocument", "xl/workbook.xml")), "xl/workbook.xml": '<workbook xmlns="w" xmlns:r="q"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": RELS.format(rel("r1", "worksheet", "worksheets/s1.xml") + rel("r2", "worksheet", "/xl/worksheets/s2.xml") + rel("r3", "sharedStrings", "ss.xml")),
        "xl/ss.xml": '<sst xmlns="w"><si><r><t>te</t></r><r><t>n</t></r><rPh><t>x</t></rPh></si></sst>',
        "xl/worksheets/s1.xml": f'<worksheet xmlns="w"><sheetData><row>{one}</row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>',
        "xl/worksheets/s2.xml": f'<worksheet xmlns="w"><sheetData><row>{cell("B2", "1", "b")}</row></sheetData></worksheet>',
        "docProps/core.xml": "<c xmlns='c'><title>Book</title><creator> </creator></c>",
    })


def document():
    p = lambda text, style="", more="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{more}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'
    num = lambda n, level=0: f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{n}"/></w:numPr>'
    tc = lambda text, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{p(text)}</w:tc>"
    rows = f'<w:tr>{tc("a", "<w:gridSpan w:val=\"2\"/>")}{tc("b")}</w:tr><w:tr>{tc("c", "<w:vMerge w:val=\"restart\"/>")}{tc("d")}{tc("e")}</w:tr><w:tr>{tc("", "<w:vMerge/>")}{tc("f")}{tc("g")}</w:tr>'
    body = p("The title", "Title") + p("Part", "H1") + p("Own", "My") + p("x = 1", "Src") + p("y = 2", "Src") + p("one", "", num(1)) + p("in", "", num(1, 1)) + p("two", "", num(1)) + p("dot", "", num(2))
    body += f"<w:tbl>{rows}</w:tbl><w:p><w:r><w:t>kept </w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"
    level = lambda i, form: f'<w:lvl w:ilvl="{i}"><w:numFmt w:val="{form}"/></w:lvl>'
    return packed(**{
        "word/document.xml": f'<w:document xmlns:w="w"><w:body>{body}</w:body></w:document>', "word/_rels/document.xml.rels": RELS.format(rel("1", "styles", "styles.xml") + rel("2", "numbering", "numbering.xml") + rel("3", "header", "h.xml") + rel("4", "footnotes", "n.xml")),
        "word/styles.xml": '<w:styles xmlns:w="w"><w:style w:styleId="Title"><w:name w:val="Title"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="My"><w:name w:val="Mine"/><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="Src"><w:name w:val="Source Code"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering xmlns:w="w"><w:abstractNum w:abstractNumId="7">{level(0, "decimal")}{level(1, "bullet")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="7"/></w:num></w:numbering>',
        "word/h.xml": f'<w:hdr xmlns:w="w">{p("Head")}</w:hdr>', "word/n.xml": f'<w:footnotes xmlns:w="w"><w:footnote w:type="separator">{p("-")}</w:footnote><w:footnote>{p("A note")}</w:footnote></w:footnotes>',
    })


def slides():
    sp = lambda x, y, text, ph="", ppr="": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\"{ph}\"/>" if ph else ""}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody><a:p>{ppr}<a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    tree = lambda *shapes: f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'
    table = '<p:graphicFrame><p:xfrm><a:off x="0" y="900000"/></p:xfrm><a:tbl><a:tr><a:tc><a:p><a:t>k</a:t></a:p></a:tc><a:tc><a:p><a:t>v</a:t></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>'
    group = f'<p:grpSp><p:grpSpPr><a:xfrm><a:off x="0" y="600000"/><a:chOff x="0" y="0"/></a:xfrm></p:grpSpPr>{sp(0, 100, "grouped")}</p:grpSp>'
    return packed(**{
        "ppt/presentation.xml": '<p:presentation xmlns:p="p" xmlns:r="r"><p:sldIdLst><p:sldId id="256" r:id="b"/><p:sldId id="257" r:id="a"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(rel("a", "slide", "slides/s1.xml") + rel("b", "slide", "slides/s2.xml")),
        "ppt/slides/s1.xml": tree(sp(0, 0, "Last", "title")), "ppt/slides/_rels/s2.xml.rels": RELS.format(rel("n", "notesSlide", "../notesSlides/n.xml")), "ppt/notesSlides/n.xml": tree(sp(0, 0, "say this")),
        "ppt/slides/s2.xml": tree(table, group, sp(500000, 200000, "right"), sp(100, 240000, "left"), sp(0, 0, "First", "ctrTitle"), sp(0, 400000, "point", "", "<a:pPr><a:buAutoNum/></a:pPr>")),
    })


def said(found):
    return [(e.label, e.level or e.depth, e.layer, e.marker, e.text) for e in found]


def test_workbooks():
    assert said(office_files.workbook(workbook())) == [("section_header", 1, "body", "", "One"), ("text", 0, "body", "", "Sales"), ("table", 0, "body", "", "| year | sum |\n| --- | --- |\n| 2020 | ten |"), ("text", 0, "body", "", "alone"), ("section_header", 1, "invisible", "", "Two"), ("text", 0, "invisible", "", "TRUE")]
    assert office_files.core_properties(workbook()) == {"title": "Book"}
    assert office_files.regions({(0, 0), (0, 1), (1, 1), (3, 3), (2, 2)}) == [[(0, 0), (0, 1), (1, 1)], [(2, 2)], [(3, 3)]]


def test_word_documents():
    assert said(office_files.document(document())) == [
        ("page_header", 0, "furniture", "", "Head"), ("title", 0, "body", "", "The title"), ("section_header", 1, "body", "", "Part"), ("section_header", 2, "body", "", "Own"), ("code", 0, "body", "", "x = 1\ny = 2"), ("list_item", 0, "body", "1.", "one"), ("list_item", 1, "body", "", "in"),
        ("list_item", 0, "body", "2.", "two"), ("list_item", 0, "body", "", "dot"), ("table", 0, "body", "", "| a | a | b |\n| --- | --- | --- |\n| c | d | e |\n| c | f | g |"), ("text", 0, "body", "", "kept new"), ("text", 0, "notes", "", "gone"), ("text", 0, "notes", "", "A note"),
    ]


def test_presentations():
    assert said(office_files.slides(slides())) == [("title", 0, "body", "", "First"), ("text", 0, "body", "", "left"), ("text", 0, "body", "", "right"), ("list_item", 0, "body", "1.", "point"), ("text", 0, "body", "", "grouped"), ("table", 0, "body", "", "| k | v |\n| --- | --- |"), ("text", 0, "notes", "", "say this"), ("title", 0, "body", "", "Last")]


def test_office_files_by_one_entry(spark):
    rows = [(1, "a.xlsx", workbook()), (2, "b.DOCX", document()), (3, "c.pptx", slides()), (4, "d.xlsx", b"no archive"), (5, "e.docx", packed(**{"word/document.xml": "<broken"})), (6, "f.pptx", None)]
    found, faults = files.read(spark.createDataFrame(rows, "doc_id long, path string, content binary"))
    assert {r.doc_id: r["count"] for r in found.groupBy("doc_id").count().collect()} == {1: 6, 2: 13, 3: 8}
    assert {r.doc_id for r in faults.collect()} == {4, 5, 6}


def brute_blocks(lines):
    out, held, page = [], [], None

    def flush():
        nonlocal held
        if held and "\n".join(held).strip():
            out.append((page, "\n".join(held).strip(), len(held)))
        held = []

    for text, no, special in lines:
        if special:
            flush()
            page = no
            held = [text]
            flush()
            continue
        if held and (no != page or (len("\n".join(held).encode()) and len("\n".join(held).encode()) + len(text) + 1 > 900)):
            flush()
        held = [text] if held == [""] else [*held, text]
        page = no
    flush()
    return out


def test_body_blocks(spark):
    lines = [("é" * (k * 37 % 400), k // 13, k % 11 == 10) for k in range(1, 90)]
    rows = [(1, k, *x) for k, x in enumerate(lines)] + [(2, 0, None, 0, False), (3, 0, "x" * 2000, 0, False), (3, 1, "y", 0, False)]
    got = pdf_pages.body_blocks(spark.createDataFrame(rows, "doc_id long, ord long, text string, page_no long, special boolean")).orderBy("doc_id", "block").collect()
    assert [(r.page_no, r.text) for r in got if r.doc_id == 1] == [b[:2] for b in brute_blocks(lines)]
    assert [(r.doc_id, len(r.text)) for r in got if r.doc_id > 1] == [(3, 2000), (3, 1)]


def test_page_quality_of_hard_pages(spark):
    rows = [(1, None, None, 0, 0, 1.0, [], False, 0.0, 0), (2, "plain words of a page", 90, 3, 0, 0.5, [0.0, 50.0, 90.0], True, 0.9, 2)]
    schema = "doc_id long, text string, rotation int, table_rows int, tables int, column_confidence double, lefts array<double>, fallback boolean, image_share double, large_images int"
    got = {r.doc_id: r for r in pdf_pages.page_quality(spark.createDataFrame(rows, schema)).collect()}
    assert (got[1].score, list(got[1].reasons)) == (0.0, ["empty_text_layer"])
    assert got[2].score == 0.0 and list(got[2].reasons) == ["unresolved_table", "ambiguous_columns", "mixed_text_image", "coordinate_less_text", "rotated_page"]
    assert pdf_pages.page_quality(spark.createDataFrame(rows, schema).where(F.lit(False))).count() == 0


def test_pivots_find_the_first_table_over_them(spark):
    rng = random.Random(5)
    big = 1 << 33
    box = lambda n: (rng.randrange(-n, n), rng.randrange(-n, n))
    pivots = [(rng.randrange(2), rng.randrange(2), *box(n), k) for k, n in enumerate([6] * 60 + [900] * 60 + [big] * 20)] + [(None, 0, 1, 1, 997), (0, 0, None, 1, 998), (9, 9, 0, 0, 999)]
    tables = [(d, s, k, left, top, left + rng.randrange(-1, n), top + rng.randrange(-1, n)) for k, n in enumerate([8] * 60 + [1_024] * 60 + [2 * big] * 30) for d, s, (left, top) in [(rng.randrange(2), rng.randrange(2), box(n))]] + [(0, 0, 500, None, 0, 1, 1), (0, None, 501, 0, 0, 1, 1)]
    over = lambda p, t: None not in (*p[:4], *t) and p[:2] == t[:2] and t[3] <= p[3] < t[5] and t[4] <= p[2] < t[6]
    want = [(p[4], min((t[2] for t in tables if over(p, t)), default=None)) for p in pivots]
    frames = spark.createDataFrame(pivots, "doc_id long, sheet long, row long, col long, k long"), spark.createDataFrame(tables, "doc_id long, sheet long, idx long, l long, t long, r long, b long")
    found = office.pivot_results(*frames)
    assert sorted((r.k, r.table_idx) for r in found.collect()) == sorted(want) and sum(x is not None for _, x in want) > 40
    keys = [line for line in found._jdf.queryExecution().toString().splitlines() if "Join" in line and "Inner" in line]
    assert keys and not any("<" in line for line in keys)  # no pairs of a sheet
