"""Page operators, budgeted chunks, exports and the readers of files, on small rows."""

import io
import random
import struct
import zipfile

from pyspark.sql import functions as F

from folioflow.functions import geometry, table, text
from folioflow.operators import chunks, exports, pages
from folioflow.sources import asciidoc, files


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, text.fold_ligatures(lit("ﬁn­e")), text.has_cjk(lit("a中")), text.has_cjk(lit("ab")), text.first_line(lit("  ab cd \nx"), 3)) == ("fine", True, False, "ab …")
    assert one(spark, text.width_estimate(lit("")), text.width_estimate(lit("中文ab")), text.style_heading_level(lit("heading 3")), text.style_heading_level(lit("Heading 0")), text.style_heading_level(lit("Body"))) == (1.0, 3.1, 3, 1, 0)
    assert one(spark, text.chart_number(lit("1,234%")), text.chart_number(lit("x")), text.chart_number(lit("NaN"))) == (1234.0, None, None)
    assert one(spark, text.clean_recognised(lit("```md\nHere is the OCR result:\nbody\n```")), text.formula_density(lit("a = b")), text.trim_line_ends(lit("a \nb\t"))) == ("body", 1 / 3, "a\nb")
    assert one(spark, *(text.plausible_heading(lit(t)) for t in ("Intro", "x", "中", "a b c d", "a b c d word", ""))) == (True, False, True, False, False, False)
    assert one(spark, text.data_uri(lit(b"ab" * 60), lit("image/png")))[0].startswith("data:image/png;base64,YWJh")


def test_recognised_faults(spark):
    bad = {"  ": "empty", "�" * 9: "garbled", "I'm sorry, no": "refused", "same line\n" * 4: "repeated", "\n".join(["line one", "other %d" % 1, "line one", "other 2", "line one", "other 3", "line one", "other 4"]): "repeated", "a\nb\na\nb\na\nb\na\nb\na": None, "| --- |\n" * 9 + "fine text": None}
    rows = spark.createDataFrame([(k,) for k in bad], "t string").select("t", pages.recognised_fault(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in rows} == bad


def test_tables(spark):
    rows = [["a", "x"], ["a", "x"], ["a", "y"]]
    arr = F.array(*(F.array(*map(F.lit, r)) for r in rows))
    assert one(spark, table.blank_repeats(arr))[0] == [["a", "x"], ["", ""], ["a", "y"]]
    gfm = "| k | v\\|w |\n| --- | --- |\n| 1 |  |"
    assert one(spark, table.parse_gfm(F.lit(gfm)), table.size_estimate(F.lit("| a | b |\n| --- | --- |\n| 1 | 2 |\nno"))) == ([["k", "v|w"], ["1", ""]], (2, 2))
    cells = spark.createDataFrame([(1, 0, 0, 1, 0, 2, "wide"), (1, 1, 1, 3, 0, 1, "tall"), (1, 2, 2, 3, 1, 2, None), (1, 3, 2, 3, 0, 1, "late")], "t long, idx long, r0 long, r1 long, c0 long, c1 long, text string")
    assert pages.grids(cells, ["t"]).first().rows == [["wide", "wide"], ["tall", ""], ["late", ""]]


def test_geometry(spark):
    box = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for x, n in zip(v, "ltrb", strict=True)))
    assert one(spark, geometry.overlap_share(box(0, 10, 10, 0), box(5, 5, 15, 0)), geometry.overlap_share(box(0, 1, 1, 0), box(2, 1, 3, 0)), geometry.from_bottom(box(1, 2, 3, 4), F.lit(10.0))["t"]) == (0.5, 0.0, 8.0)
    step = F.struct(F.lit(2.0).alias("sx"), F.lit(3.0).alias("sy"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"))
    assert tuple(one(spark, geometry.moved(F.struct(F.lit(1).alias("x"), F.lit(1).alias("y")), F.array(step, step)))[0]) == (7.0, 9.0)


def test_places_on_pages(spark):
    boxes = spark.createDataFrame([(1, 0.0, 2.0, 2.0, 0.0), (1, 1.0, 3.0, 3.0, 1.0), (1, 0.0, 2.0, 2.0, 0.0), (2, 0.0, 1.0, 1.0, 0.0)], "page long, l double, t double, r double, b double")
    assert {r.page: r.area for r in pages.covered_area(boxes, ["page"]).collect()} == {1: 7.0, 2: 1.0}
    edges, at = F.array(*map(F.lit, (0.0, 10.0, 30.0, 45.0))), F.array(F.lit(0.0), F.lit(30.0))
    assert one(spark, pages.left_anchors(edges), pages.nearest_anchor(F.lit(29.0), at, F.lit(5.0)), pages.nearest_anchor(F.lit(15.0), at, F.lit(5.0))) == ([0.0, 30.0], 1, -1)
    lines = spark.createDataFrame([(1, 1, 0.5, 1.5, 0.5, 1.5), (1, 2, 9.0, 9.0, 9.0, 9.0), (3, 3, 0.5, 1.5, 0.5, 1.5)], "page long, id long, min_x double, max_x double, min_y double, max_y double")
    assert sorted(r.id for r in pages.outside_boxes(lines, boxes).collect()) == [2, 3]
    shapes = spark.createDataFrame([(1, 0, 10.0, 5.0), (1, 1, 11.0, 1.0), (1, 2, 30.0, 0.0)], 'page long, ord long, top double, "left" double'.replace('"', "`"))
    assert [r.ord for r in pages.shape_rows(shapes, ["page"], 2.0).orderBy("place").collect()] == [1, 0, 2]
    words = spark.createDataFrame([(1, 0.0, 10.0, 10.0, "a"), (1, 13.0, 20.0, 10.0, "b"), (1, 40.0, 50.0, 10.0, "c")], "line long, min_x double, max_x double, font double, text string")
    assert [(r.cell, r.text) for r in pages.row_cells(words, ["line"]).orderBy("cell").collect()] == [(0, "a b"), (1, "c")]
    glyphs = spark.createDataFrame([(1, x, y, 5.0, t) for x, y, t in ((0.0, 100.0, "H"), (5.0, 99.0, "i"), (12.0, 100.0, "x"), (0.0, 100.0, "H"), (0.0, 90.0, "中"), (20.0, 90.0, "文"), (9.0, 90.0, " "))], "page long, x double, y double, w double, text string")
    assert [r.text for r in pages.assembled_lines(glyphs, ["page"]).orderBy("line").collect()] == ["Hi x", "中文"]


def test_budgets(spark):
    assert chunks.budget([([], "abcdefghij", "text")], most=6) == [([], "abcdef"), ([], "ghij")]
    assert chunks.budget([(["H"], "one", "text"), (["H"], "two", "text")], most=12) == [(["H"], "one\n\ntwo")]
    assert len(chunks.budget([(["H"], "one", "text"), (["H"], "two", "text")], most=12, merge=False)) == 2
    assert chunks.budget([(["A long heading"], "Hi. There.", "text")], most=8) == [([], "Hi."), ([], " There.")]
    head, rows = "| a | b |\n| --- | --- |", [f"| {k} | v{k} |" for k in range(5)]
    parts = chunks.budget([([], "\n".join([head, *rows]), "table")], most=44, merge=False)
    assert all(p.startswith(head) and len(p) <= 44 for _, p in parts) and [x for _, p in parts for x in p.split("\n")[2:]] == rows
    assert chunks.budget([([], "word " * 9, "text")], most=3, count=lambda t: len(t.split()), merge=False)[0] == ([], "word word word ")
    assert chunks.budget([([], "", "text")], most=5) == [([], "")] and chunks.budget([]) == []


def test_asciidoc():
    source = "﻿= Top\n\nOne\ntwo\n\n== Part\n\n* a\n  * b\n* c\n+\n....\nlit\n....\n\n1. n\n\n.Sums\n|===\n|k |v\n|1 |2\n|===\n\n[source,py]\n----\nx = 1\n----\n\nimage::p.png[Alt]\n"
    assert [(e.label, e.level, e.depth, e.text) for e in asciidoc.parse(source)] == [
        ("title", 0, 0, "Top"), ("text", 0, 0, "One two"), ("section_header", 1, 0, "Part"), ("list_item", 0, 0, "a"), ("list_item", 0, 1, "b"), ("list_item", 0, 0, "c"), ("code", 0, 0, "lit"), ("list_item", 0, 0, "n"),
        ("caption", 0, 0, "Sums"), ("table", 0, 0, "| k | v |\n| --- | --- |\n| 1 | 2 |"), ("code", 0, 0, "x = 1"), ("picture", 0, 0, "p.png"), ("caption", 0, 0, "Alt"),
    ]
    assert asciidoc.parse("") == [] and asciidoc.parse("....\nopen")[0].text == "open"


def test_files_of_all_formats(spark):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="c"><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>')
        z.writestr("o/b.opf", '<package xmlns="p"><manifest><item id="x" href="two.xhtml"/><item id="y" href="one.xhtml"/></manifest><spine><itemref idref="y"/><itemref idref="x"/></spine></package>')
        z.writestr("o/one.xhtml", "<h1>One</h1><p>a</p>")
        z.writestr("o/two.xhtml", "<h2>Two</h2>")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 640, 480)
    rows = [(1, "a.TXT", b"\xef\xbb\xbfhi "), (2, "b.md", b"# T"), (3, "c.csv", b"a,b\n1,2"), (4, "d.epub", packed.getvalue()), (5, "e.png", png), (6, "f.exe", b"x"), (7, "g.epub", b"no"), (8, None, None), (9, "h.adoc", b"= T")]
    data = spark.createDataFrame(rows, "doc_id long, path string, content binary")
    found, faults = files.read(data)
    said = {}
    for r in found.orderBy("doc_id", "ord").collect():
        said.setdefault(r.doc_id, []).append((r.label, r.text))
    assert said == {1: [("text", "hi")], 2: [("title", "T")], 3: [("table", "| a | b |\n| --- | --- |\n| 1 | 2 |")], 4: [("title", "One"), ("text", "a"), ("section_header", "Two")], 5: [("picture", "")], 9: [("title", "T")]}
    assert {r.doc_id for r in faults.collect()} == {6, 7, 8}
    assert files.raster_size(png) == (640, 480) and files.raster_size(b"") is None
    assert tuple(data.where("doc_id = 5").select(files.png_size(F.col("content"))).first()[0]) == (640, 480)


def test_exports(spark):
    source = "# T & t\n\n- a\n  - b\n- c\n\n| k |\n| - |\n| 1 |\n"
    found, _ = files.read(spark.createDataFrame([(1, "a.md", source.encode())], "doc_id long, path string, content binary"))
    page = exports.to_html(found).first().html
    body = page.split("<body>\n")[1]
    assert body == "<h1>T &amp; t</h1>\n<ul>\n<li>a\n<ul>\n<li>b</li>\n</ul>\n</li>\n<li>c</li>\n</ul>\n<table>\n<thead>\n<tr><th>k</th></tr>\n</thead>\n<tbody>\n<tr><td>1</td></tr>\n</tbody>\n</table>\n</body>\n</html>\n"
    assert '"label":"title"' in exports.to_json(found).first().json
    items = spark.createDataFrame([(1, 0, "text", "H", 2, None), (1, 1, "text", "x", None, "list_item"), (1, 2, "text", "p", None, "text"), (1, 3, "image", "i.png", None, None)], "doc_id long, order_index long, type string, text string, text_level long, label string")
    assert exports.items_markdown(items).first().markdown == "## H\n\n- x\n\np\n\n![图片](i.png)\n\n"


def test_first_pages(spark):
    rows = [(1, 0, 0, "Small", 9.0), (1, 0, 1, "Title", 20.0), (1, 1, 2, "Later", 20.0), (2, 1, 0, "Not on the cover", 20.0), (2, 0, 1, "x", 9.0), (3, 0, 0, "t" * 41, 9.0)]
    lines = spark.createDataFrame(rows, "doc_id long, page_no long, ord long, text string, font double")
    assert [tuple(r) for r in pages.cover_titles(lines).collect()] == [(1, 1)]
    few = pages.page_budget(spark.createDataFrame([(1, k) for k in range(5)] + [(2, 7)], "doc_id long, page_no long"), ["doc_id"], 2)
    assert sorted(map(tuple, few.collect())) == [(1, 0), (1, 1), (2, 7)]


def brute_fault(t):
    import re

    if not t.strip():
        return "empty"
    if t.strip().lower().startswith("i'm sorry"):
        return "refused"
    lines = [x for line in t.split("\n") if len(x := " ".join(line.split()).lower()) >= 4 and not re.fullmatch(r"[|\-: \t]*", x)]
    run = any(len(set(lines[k : k + 4])) == 1 for k in range(len(lines) - 3))
    often = len(lines) >= 8 and 2 * max(map(lines.count, lines)) >= len(lines)
    return "repeated" if run or often else "good"


def test_recognised_faults_read_whole_texts(spark, tmp_path):
    from folioflow.plans import page_plans

    texts = {1: "first line\n" + "said again\n" * 4, 2: "first line\n" + "a line\nother\n" * 3 + "a line\na line\n", 3: "first\nsecond\nthird", 5: "plain", 7: "plain", 11: "one\n" + "more of it\n" * 5, 22: "fine text", 13: "  \n ", 17: "\n".join(f"line {k}" for k in range(3000))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    said = {k: "one line\n" * 4 + t if k % 5 == 0 else "I'm sorry, " + t if k % 7 == 0 else t for k, t in texts.items()}
    got = {r.doc_id: r.fault for r in page_plans.recognised_faults(spark, str(tmp_path)).collect()}
    assert got == {k: brute_fault(t) for k, t in said.items()}
    assert (got[1], got[2], got[11], got[22], got[17]) == ("repeated", "repeated", "repeated", "good", "good")


def all_lines(sf_dir):
    """(page, ord) with its least part key and quantity, over the whole table."""
    import pyarrow.parquet as pq

    least = {}
    for r in pq.read_table(f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]).to_pylist():
        p, q = least.get(at := (r["l_orderkey"], r["l_linenumber"]), (r["l_partkey"], r["l_quantity"]))
        least[at] = min(p, r["l_partkey"]), min(q, r["l_quantity"])
    return least


def test_covered_areas_of_all_pages(spark):
    from folioflow.plans import page_plans

    unit = {}
    for (page, _), (p, q) in all_lines("/root/testdata/sf0.001").items():
        unit.setdefault(page, set()).update((p % 40 + i, int(q * 2) - 6 + j) for i in range(10) for j in range(6))
    got = {r.page: r.area for r in page_plans.covered_areas(spark, "/root/testdata/sf0.001").collect()}
    assert got == {page: float(len(cells)) for page, cells in unit.items()} and any(page % 4 for page in got)


def test_cell_grids_of_all_lines(spark):
    from folioflow.plans import page_plans

    cells = {}
    for page, o in sorted(all_lines("/root/testdata/sf0.001")):
        cells.setdefault(page, {}).update({o - 1: f"{o}|{o}", o: f"{o}|{o}"})  # later cells win
    got = {r.page: r.grid for r in page_plans.cell_grids(spark, "/root/testdata/sf0.001").collect()}
    assert got == {page: "/".join(rows.get(r, "|") for r in range(max(rows) + 1)) for page, rows in cells.items()}
    assert any(max(rows) > 4 for rows in cells.values())


def test_a_recognised_text_is_stripped_and_lowered_once(spark):
    df = spark.createDataFrame([(1, "　 \x85 fine \xa0"), (2, None), (3, "  \x1c"), (4, "a\x01� b"), (5, " I'M SORRY")], "k long, text string")
    plan = df.select(pages.recognised_fault(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text#") == 2 and "contains(lower(" not in plan  # the column itself, and one use of it
    said = df.select("k", text.strip(F.col("text")).alias("s"), F.round(text.garbage_ratio(F.col("text")), 3).alias("g"), pages.recognised_fault(F.col("text")).alias("f")).orderBy("k").collect()
    assert [tuple(r) for r in said] == [(1, "fine", 0.0, None), (2, None, 0.0, "empty"), (3, "\x1c", 1.0, "garbled"), (4, "a\x01� b", 0.6, "garbled"), (5, "I'M SORRY", 0.0, "refused")]


def test_repeats_of_long_tables_are_blanked_in_blocks(spark):
    bare = lambda r: all(c.strip(" ") in ("", "---") for c in r)

    def plain(rows):
        done = []
        for row in rows:
            above = done[-1] if done else []
            done.append(["" if not bare(above) and c.strip(" ") and k < len(above) and c.strip(" ") == above[k].strip(" ") else c for k, c in enumerate(row)])
        return done

    rng = random.Random(2)
    made = [[[rng.choice(["a", " a", "b", "", "---"]) for _ in range(rng.randrange(4))] for _ in range(n)] for n in (0, 1, 2, 3, 4, 50, 101)]
    df = spark.createDataFrame([(k, rows) for k, rows in enumerate([*made, None])], "k long, rows array<array<string>>").withColumn("out", table.blank_repeats(F.col("rows")))
    assert [r.out for r in df.orderBy("k").collect()] == [*map(plain, made), None]
    assert "sqrt" in df._jdf.queryExecution().optimizedPlan().toString().lower()  # blocks of the root's length
