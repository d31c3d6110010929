"""Readers of markup, and operators over elements."""

import email.policy

from pyspark.sql import functions as F

from folioflow.operators import document, places
from folioflow.sources import html_pages, mail, markdown


def _said(found):
    return [(e.label, e.level, e.depth, e.text) for e in found]


def test_markdown_blocks():
    text = "# Top\n\nA *b* [c](d)\nmore\n\n- one\n  - two\n\n1. first\n\nUnder\n-----\n\n| a | b |\n| - | - |\n| 1 | x\\|y |\n\n~~~py\n# no heading\n~~~\n![alt](p.png)\n"
    assert _said(markdown.parse(text)) == [
        ("title", 0, 0, "Top"), ("text", 0, 0, "A b c more"), ("list_item", 0, 0, "one"), ("list_item", 0, 1, "two"), ("list_item", 0, 0, "first"), ("section_header", 1, 0, "Under"),
        ("table", 0, 0, "| a | b |\n| --- | --- |\n| 1 | x\\|y |"), ("code", 0, 0, "# no heading"), ("picture", 0, 0, "p.png"), ("caption", 0, 0, "alt"),
    ]
    assert markdown.parse("") == [] and markdown.parse("\n \n") == []


def test_html_blocks():
    page = "<title>T</title><nav>menu</nav><h1>Head</h1><p>a &amp; b<br>c<ul><li>x<ol><li>y</ol></ul><script>no</script><p hidden>no</p><table><tr><th>k<th>v<tr><td>1<td>2</table><h3>Sub</h3><pre>a\n b</pre>"
    found = html_pages.parse(page)
    assert _said(found) == [
        ("title", 0, 0, "T"), ("text", 0, 0, "menu"), ("title", 0, 0, "Head"), ("text", 0, 0, "a & b\nc"), ("list_item", 0, 0, "x"), ("list_item", 0, 1, "y"),
        ("table", 0, 0, "| k | v |\n| --- | --- |\n| 1 | 2 |"), ("section_header", 2, 0, "Sub"), ("code", 0, 0, "a\n b"),
    ]
    assert [e.layer for e in found][:3] == ["furniture", "furniture", "body"]
    assert found[5].marker == "1." and html_pages.parse("") == []


def test_mail_takes_the_html_form_and_names_attachments():
    raw = 'Subject: S\nFrom: a@b.c\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: multipart/alternative; boundary=Y\n\n--Y\nContent-Type: text/plain\n\nplain\n--Y\nContent-Type: text/html\n\n<p>rich</p>\n--Y--\n--X\nContent-Type: application/pdf\nContent-Disposition: attachment; filename="f.pdf"\n\nx\n--X--\n'
    assert [e.text for e in mail.parse(raw)] == ["S", "From: a@b.c", "rich", "f.pdf (application/pdf)"]
    assert mail.parse("") == []


def test_a_mails_head_lines_are_parsed_once(monkeypatch):
    seen, default = [], email.policy.EmailPolicy.header_fetch_parse
    monkeypatch.setattr(email.policy.EmailPolicy, "header_fetch_parse", lambda self, name, value: seen.append(name) or default(self, name, value))
    mail._head_line.cache_clear()
    found = mail.parse(f"Subject: {'long ' * 300}\nFrom: A <a@b.c>\nContent-Type: text/plain; charset=utf-8\n\none\n")
    assert [e.text for e in found] == [("long " * 300).strip(), "From: A <a@b.c>", "one"]
    assert max(seen.count(name) for name in seen if name != "Subject") == 1


def test_markdown_of_markdown(spark):
    text = "# T\n\n- a\n- b\n\npara\n\n```sql\nSELECT 1\n```\n"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in document.to_markdown(markdown.read(docs)).collect()] == [(1, text)]


def test_layers_and_noise(spark):
    e = spark.createDataFrame([(1, 0, "text", "body"), (1, 1, "page_header", "furniture"), (1, 2, "text", None)], "doc_id long, ord long, label string, layer string")
    assert document.in_layers(e).count() == 2 and document.in_layers(e, "furniture, x").count() == 1
    assert document.without_noise(e).count() == 2 and document.without_noise(e, ()).count() == 3


def test_reply_cycles_are_their_own_roots(spark):
    c = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 5), (1, 5, 4), (1, 6, 99), (1, 7, 4)], "doc_id long, id long, parent long")
    assert sorted((r.id, r.root) for r in places.reply_roots(c).collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (7, 7)]
    assert places.reply_roots(c.limit(0)).collect() == []


def test_paths_keep_their_place_after_a_jump(spark):
    docs = spark.createDataFrame([(1, "# A\n\n#### B\n\n### C\n\nx\n")], "doc_id long, text string")
    found = markdown.read(docs)
    assert document.section_paths(found).where("text = 'x'").first().section_path == ["A", "B", "C"]
    assert document.heading_contexts(found).where("text = 'x'").first().headings == ["A", "C"]


def test_content_chunks(spark):
    from folioflow.operators import chunks

    docs = spark.createDataFrame([(1, "aaaa\n\nbbbb\n\ncccccccccccc\n\n# H\n\nd\n\ne\n\n| k |\n| - |\n| 1 |\n| 2 |\n| 3 |\n")], "doc_id long, text string")
    out = chunks.content(document.content_items(markdown.read(docs)), size=10, rows=2).orderBy("chunk_no").collect()
    assert [r.content for r in out] == ["aaaa\nbbbb", "cccccccccc", "cc", "H", "d\ne", "| k |\n| --- |\n| 1 |\n| 2 |", "| k |\n| --- |\n| 3 |"]
    assert chunks.content(document.content_items(markdown.read(docs.limit(0)))).count() == 0


def test_nearest_equals_brute_force(spark):
    boxes = [(p, k, x, y, x + 2.0, y + 4.0) for p, n in ((1, 40), (2, 1), (3, 30)) for k in range(n) for x, y in [((k * 37 % 101) * (1.0 if p == 1 else 0.01), (k * 53 % 89) * 1.0)]]
    boxes += [(1, 900, 1e6, 1e6, 1e6, 1e6), (1, 901, 1.0, 2.0, 3.0, 4.0), (1, 902, 3.0, 4.0, 1.0, 2.0), (3, 903, float("nan"), 0.0, 1.0, 1.0), (4, 904, 0.0, None, 1.0, 1.0)]
    points = [(p, k, (k * 29 % 97) * 1.3 - 9, (k * 31 % 83) * 1.7 - 20) for p in (1, 2, 3, 4, 5) for k in range(25)] + [(1, 77, 5e5, 5e5), (2, 78, float("inf"), 0.0), (3, 79, None, 0.0), (1, 80, 2.0, 3.0)]
    frame = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n in ('page', 'ref', 'id') else 'double'}" for n in names.split()))
    got = {(r.page, r.id): r.ref for r in places.nearest(frame(points, "page id x y"), frame(boxes, "page ref l t r b")).collect()}
    finite = lambda *v: all(x is not None and abs(x) < float("inf") for x in v)
    want = {}
    for p, i, x, y in points:
        near = [((x - (left + right) / 2) ** 2 + (y - (t + b) / 2) ** 2, ref) for q, ref, left, t, right, b in boxes if p == q and finite(left, t, right, b)] if finite(x, y) else []
        if near:
            want[p, i] = min(near)[1]
    assert got == want and want[1, 80] == 901
    assert places.nearest(frame(points, "page id x y").limit(0), frame(boxes, "page ref l t r b")).columns == ["page", "id", "ref"]


def test_pieces_of_long_texts(spark):
    from folioflow.functions.text import fixed_chunks

    texts = ["a😀\n" * 1000, "", None, "x" * 900, "y" * 901]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(fixed_chunks(F.col("t"), 900)).collect()]
    assert got == [[t[k : k + 900] for k in range(0, len(t), 900)] if t else [] for t in texts]
