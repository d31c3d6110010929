"""Columns of pages, formulas of charts, visual results, LaTeX and counts."""

import random

import numpy as np

from folioflow.functions import latex
from folioflow.operators import columns, ranges, statistics, visual

PAGE = "page long, ord long, min_x double, max_x double, min_y double, max_y double, font double"


def order(lines):
    return columns.column_order(np.array([(*line, 10.0) for line in lines], dtype=float).reshape(-1, 5)).tolist()


def column(x, heights, width=180):
    return [(x, x + width, y, y + 10) for y in heights]


def test_columns():
    down = (700, 650, 600)
    assert order(column(50, down) + column(300, down)) == [0, 1, 2, 3, 4, 5]
    assert order(column(300, down) + column(50, down)) == [3, 4, 5, 0, 1, 2]
    assert order(column(300, down) + column(240, down, 50)) == [0, 1, 2, 3, 4, 5]  # a gutter of 10 points
    assert order(column(300, (700, 650)) + column(50, (500, 450))) == [0, 1, 2, 3]  # one below the other
    assert order(column(300, down) + column(50, down) + [(60, 310, 675, 685)]) == [0, 1, 2, 3, 4, 5, 6]  # a line over half of it
    three = column(450, down, 120) + column(250, down, 120) + column(50, down, 120)
    assert order(three) == [6, 7, 8, 3, 4, 5, 0, 1, 2]
    assert order([]) == [] and order([(0, 0, 1, 2)] * 5) == [0, 1, 2, 3, 4]


def test_orders_are_whole():
    rng = random.Random(5)
    for _ in range(200):
        lines = [(x, x + rng.choice((40, 90, 400)), y, y + 10) for x, y in ((rng.choice((0, 150, 300)), rng.randrange(0, 700, 20)) for _ in range(rng.randrange(1, 60)))]
        assert sorted(order(lines)) == list(range(len(lines)))


def test_pages_without_places(spark):
    rows = [(1, k, None if k == 3 else 1.0, 9.0, 1.0, 2.0, None) for k in range(5)] + [(2, 7, 1.0, 2.0, 1.0, 2.0, 1.0), (None, 4, 1.0, 2.0, 1.0, 2.0, 1.0)]
    lines = spark.createDataFrame(rows, PAGE)
    assert sorted((r.page, r.ord, r.place) for r in columns.by_columns(lines.where("page is not null"), ["page"]).collect()) == [(1, k, k) for k in range(5)] + [(2, 7, 0)]
    assert columns.by_columns(lines.limit(0), ["page"]).count() == 0


def test_ranges(spark):
    said = ["=Sheet1!$A$1", "'a!b'!B2:A1", "'[b.xlsx]It''s'!AA10:AB10", "A1:B2", "S!A1,S!B1", "S!A0", "", None, "S!A1:B2:C3"]
    f = spark.createDataFrame([(1, k, s) for k, s in enumerate(said)], "doc_id int, formula_id int, formula string")
    none = spark.createDataFrame([], "doc_id int, name string, scope string, refers_to string"), spark.createDataFrame([], "doc_id int, sheet string, name string, r0 int, c0 int, r1 int, c1 int, columns array<string>, header_rows int, totals_rows int")
    got = {r.formula_id: r["at"] and tuple(r["at"]) for r in ranges.resolved(f, *none).collect()}
    assert got == {0: ("Sheet1", 1, 1, 1, 1), 1: ("a!b", 1, 1, 2, 2), 2: ("It's", 10, 27, 10, 28)} | dict.fromkeys(range(3, 9))
    big = f.limit(1).selectExpr("doc_id", "formula_id", "named_struct('sheet', 's', 'r0', 1L, 'c0', 1L, 'r1', 100001L, 'c1', 1L) AS at")
    cells = spark.createDataFrame([], "doc_id int, sheet string, row long, col long, value string")
    assert ranges.points(big, cells).count() == 0 and ranges.points(big, cells, 100_001).count() == 100_001


def test_latex(spark):
    row = spark.range(1).select(latex.escape(latex.F.lit("a_b\\α😀")).alias("a"), latex.limits(latex.F.lit(None).cast("string"), latex.F.lit("2")).alias("b"), latex.delimiter(latex.F.lit(None).cast("string")).alias("c"), latex.escape(latex.F.lit("")).alias("d")).first()
    assert tuple(row) == (r"a\_b\backslash{}\alpha 😀", "^{2}", ".", "")


def test_visual_results(spark):
    schema = f"page int, ord int, label string, text string, level int, confidence double, l double, t double, r double, b double, rows long, cols long, turn int, cells {visual.CELLS}"
    good = ("text", "x", None, 0.9, 1.0, 9.0, 9.0, 1.0, None, None, None, None)
    changed = lambda **kw: tuple(kw.get(n, v) for n, v in zip(("label", "text", "level", "confidence", "l", "t", "r", "b", "rows", "cols", "turn", "cells"), good, strict=True))
    table = {"label": "table", "text": None, "rows": 2, "cols": 2, "turn": 0}
    cases = {
        None: good, "fields": changed(label=None), "box": changed(r=float("nan")), "confidence": changed(confidence=0.1), "empty text": changed(text=None), "level": changed(label="section_header"), "table direction": changed(**{**table, "turn": 45}),
        "empty table": changed(**table, cells=[(0, 1, 0, 1, " ")]), "number of cells": changed(**table, cells=[]), "cell outside": changed(**table, cells=[(0, 3, 0, 1, "a")]), "garbled": changed(text="���a"),
    }
    items = spark.createDataFrame([(k, 0, *row) for k, row in enumerate(cases.values())] + [(99, k, *changed(text=str(k))) for k in range(2001)], schema)
    pages = spark.createDataFrame([(k, 0.0, 0.0) for k in range(len(cases))] + [(99, 0.0, 0.0)], "page int, width double, height double")
    assert {r.page: r.fault for r in visual.page_faults(items, pages).collect()} == dict(enumerate(cases)) | {99: "number of items"}
    assert visual.page_faults(items.limit(0), pages.limit(0)).count() == 0


def test_counts_of_nothing(spark):
    e = spark.createDataFrame([(1, "picture", None), (1, "formula", None)], "doc_id int, label string, text string")
    assert statistics.document_counts(e).first().asDict() == {"doc_id": 1, "texts": 1, "tables": 0, "pictures": 1, "pictures_with_data": 0, "formulas": 1, "formula_chars": 0, "rows": 0, "cols": 0}
    assert statistics.label_counts(e.limit(0)).count() == 0
