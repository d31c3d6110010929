"""Command line: one file in, its outline, Markdown, content list or JSON tree out."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.table import size_estimate
from folioflow.operators import document, exports, tree_json
from folioflow.sources import files

FORMATS = ("outline", "md", "content-list", "json")
#: The words of an outline.
NO_HEADINGS, NO_TABLES = "  (无标题结构)", "  (无表格)"


def read_source(source: str, name: str | None) -> tuple[str, bytes]:
    """(name, content) of a file, or of standard input, which needs a name to tell its format."""
    if source == "-":
        if not name:
            raise ValueError("standard input needs --name, such as report.xlsx")
        return name, sys.stdin.buffer.read()
    with open(source, "rb") as f:
        return source, f.read()


def outline_of(name: str, items: list[dict]) -> str:
    """A document's counts, first groups, headings by level and tables with their size."""
    kind = lambda k: [i for i in items if i["type"] == k]
    out = [f"文档: {name} | {len(kind('text'))} 文本块 | {len(kind('table'))} 表格 | {len(kind('image'))} 图片"]
    groups = list(dict.fromkeys(i["section_path"][0] for i in items if i["section_path"]))
    if len(groups) > 1:
        out.append(f"分组({len(groups)}): {' / '.join(groups)}")
    heads = [f"{'  ' * min(i['text_level'], 6)}- {' '.join(i['text'].split())[:80]}" for i in items if i["text_level"]]
    tables = [f"  #{k} {i['rows']}行x{i['cols']}列 ({' / '.join(i['section_path'][-2:])})" for k, i in enumerate(kind("table"), 1)]
    return "\n".join([*out, "", "标题树:", *(heads or [NO_HEADINGS]), "", "表格:", *(tables or [NO_TABLES])]) + "\n"


def _only(frame: DataFrame, column: str) -> str:
    row = frame.select(column).first()
    return row[0] if row else ""


def render(spark: SparkSession, name: str, content: bytes, form: str, section: str = "", sheet: str = "", layers: str = "body") -> str:
    """One file's output. A file that its reader refuses raises ValueError."""
    one = spark.createDataFrame([(0, name, bytearray(content))], "doc_id long, path string, content binary")
    elements, faults = files.read_all(one)
    if fault := faults.first():
        raise ValueError(fault.error)
    if form == "json":
        return json.dumps(json.loads(_only(tree_json.to_tree(elements), "json") or "{}"), ensure_ascii=False, indent=2) + "\n"
    if form == "md" and not (section or sheet):
        return _only(document.to_markdown(document.in_layers(elements, layers)), "markdown")
    items = document.in_section(document.content_items(elements), section, sheet)
    if form == "md":
        return _only(exports.items_markdown(items.withColumn("label", F.col("type"))), "markdown")
    if form == "outline":
        size = size_estimate(F.col("text"))
        rows = items.withColumn("_s", F.when(F.col("type") == "table", size)).withColumn("rows", F.col("_s.n_rows")).withColumn("cols", F.col("_s.n_cols")).drop("_s")
        return outline_of(os.path.basename(name), [r.asDict() for r in rows.orderBy("order_index").toLocalIterator()])
    found = [{k: v for k, v in r.asDict().items() if k != "doc_id" and v is not None} for r in items.orderBy("order_index").toLocalIterator()]
    return json.dumps(found, ensure_ascii=False, indent=2) + "\n"


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = argparse.ArgumentParser(prog="folioflow")
    parse = top.add_subparsers(dest="command", required=True).add_parser("parse", help="read one file")
    parse.add_argument("source", help="a file, or - for standard input")
    parse.add_argument("--format", default="outline", choices=FORMATS)
    parse.add_argument("--section", default="", help="only items below a heading that holds this (md, content-list)")
    parse.add_argument("--sheet", default="", help="only items of a first group that holds this (md, content-list)")
    parse.add_argument("--layers", default="body", help="layers of Markdown, comma-separated")
    parse.add_argument("--out", default="", help="write here instead of standard output")
    parse.add_argument("--name", default="", help="name of standard input")
    given = top.parse_args(args)
    try:
        name, content = read_source(given.source, given.name)
        spark = spark or SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
        said = render(spark, name, content, given.format, given.section, given.sheet, given.layers)
    except (OSError, ValueError) as e:
        print(f"folioflow: {e}", file=sys.stderr)
        return 1
    if given.format == "json" and (given.section or given.sheet):
        print("folioflow: --section and --sheet don't apply to json", file=sys.stderr)
    if given.out:
        with open(given.out, "w", encoding="utf-8") as f:
            f.write(said)
    else:
        sys.stdout.write(said if said.endswith("\n") else said + "\n")
    return 0
