"""Benchmark decontamination: pigeonhole pieces find candidates, bit-parallel edit distance confirms them."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import durable, map_arrow, texts

#: Edits allowed for each hundred characters of an item.
ERROR_PERCENT = 5
#: Characters of benchmark items that one automaton holds; more items take more automata, one after the other.
BLOCK_CHARS = 4_000_000
#: Characters of a piece's beginning by which one pass picks the documents that several blocks search; shorter pieces count whole.
HEAD = 16


def normal(text: str) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.split()).lower()


def places(text: str) -> list[int]:
    """For each character of normal(text), where it stands in text; at the end, where the last one stops."""
    out, gap, last = [], False, 0
    for k, c in enumerate(text):
        if c.isspace():
            gap = True
            continue
        if gap and out:
            out.append(last)
        gap, last = False, k + 1
        out.extend([k] * len(c.lower()))
    return [*out, last]


def pieces(item: str, percent: int = ERROR_PERCENT) -> tuple[int, list[tuple[int, str]]]:
    """(error budget, its number plus one of pieces with their offsets): k edits leave one piece whole at least."""
    budget = len(item) * percent // 100
    cuts = [len(item) * j // (budget + 1) for j in range(budget + 2)]
    return budget, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the first best match of item ending anywhere in text, after Myers: a column of the matrix is two machine integers."""
    m = len(item)
    full, top, at = (1 << m) - 1, 1 << (m - 1), {}
    for k, c in enumerate(item):
        at[c] = at.get(c, 0) | 1 << k
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = at.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus, vertical = (plus << 1) & full, (minus << 1) & full, eq | down
        up, down = minus | (full & ~(vertical | plus)), plus & vertical
        if score < best:
            best, end = score, j
    return best, end


def automaton(items: list[tuple[int, str]], percent: int = ERROR_PERCENT) -> ahocorasick.Automaton:
    found: dict[str, list[tuple[int, int]]] = {}
    for n, (_, item) in enumerate(items):
        for offset, piece in pieces(item, percent)[1]:
            found.setdefault(piece, []).append((n, offset))
    out = ahocorasick.Automaton()
    for piece, where in found.items():
        out.add_word(piece, (len(piece), where))
    out.make_automaton()
    return out


def matches(text: str | None, items: list[tuple[int, str]], machine: ahocorasick.Automaton, percent: int = ERROR_PERCENT) -> list[tuple[int, int, int, int]]:
    """(item_id, distance, start, end) of the best match within budget of each item, in code points of text."""
    seen = normal(text or "")
    windows: dict[int, list[list[int]]] = {}
    for last, (length, where) in machine.iter(seen):
        for n, offset in where:
            m = len(items[n][1])
            budget = m * percent // 100
            begin = last - length + 1 - offset
            lo, hi = max(0, begin - budget), begin + m + budget
            own = windows.setdefault(n, [])
            if own and lo <= own[-1][1] and lo >= own[-1][0]:
                own[-1][1] = max(own[-1][1], hi)
            elif not own or not any(a <= lo and hi <= b for a, b in own[-4:]):
                own.append([lo, hi])
    out, place = [], None
    for n, own in windows.items():
        item_id, item = items[n]
        best = None
        for lo, hi in own:
            window = seen[lo:hi]
            distance, end = nearest(item, window)
            if distance <= len(item) * percent // 100 and (best is None or (distance, lo + end) < best[:2]):
                best = (distance, lo + end, lo)
        if best:
            distance, end, lo = best
            back = nearest(item[::-1], seen[lo:end][::-1])[1]
            place = place or places(text)
            out.append((item_id, distance, place[end - back], place[end - 1] + 1))
    return sorted(out)


def blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """Items, without those that are null or blank, in lists of bounded size; equal items stay apart by their ids."""
    block, chars = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null").toLocalIterator():
        item = normal(r.t)
        if not item:
            continue
        if block and chars + len(item) > BLOCK_CHARS:
            yield block
            block, chars = [], 0
        block.append((r.i, item))
        chars += len(item)
    if block:
        yield block


def window_hashes(text: str, width: int) -> np.ndarray:
    """A 64-bit hash of each window of width characters."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    v = c[: max(len(c) - width + 1, 0)]
    for k in range(1, width):
        v = v * np.uint64(0x9E3779B97F4A7C15) + c[k : k + len(v)]
    return v


def heads(found: Iterator[list[tuple[int, str]]], percent: int = ERROR_PERCENT) -> tuple[int, dict[int, np.ndarray]]:
    """(number of blocks, sorted hashes of the beginnings of all pieces by their length): eight bytes a piece."""
    n, parts = 0, {}
    for n, block in enumerate(found, 1):
        own: dict[int, set[str]] = {}
        for _, item in block:
            for _, piece in pieces(item, percent)[1]:
                own.setdefault(min(len(piece), HEAD), set()).add(piece[:HEAD])
        for width, said in own.items():
            parts.setdefault(width, []).append(window_hashes("".join(sorted(said)), width)[::width])
    return n, {width: np.unique(np.concatenate(p)) for width, p in parts.items()}


def likely(text: str | None, known: dict[int, np.ndarray]) -> bool:
    """Whether a piece's beginning may stand in text; never false where one does."""
    seen = normal(text or "")
    for width, hashes in known.items():
        v = window_hashes(seen, width)
        if len(v) and (hashes[np.minimum(np.searchsorted(hashes, v), len(hashes) - 1)] == v).any():
            return True
    return False


def _likely(known, text_col: str, want: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([likely(t, known.value) is want for t in texts(batch, text_col)], pa.bool_()))

    return run


def _search(items, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items.value, percent)
        for batch in batches:
            rows = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), texts(batch), strict=True) for m in matches(t, items.value, machine, percent)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def _clean(items, percent: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(items.value, percent)
        for batch in batches:
            yield batch.filter(pa.array([not matches(t, items.value, machine, percent) for t in texts(batch, text_col)], pa.bool_()))

    return run


def search(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start, end): for each row and each item that it holds within percent edits, the best place.

    Texts are compared in lower case with white space as single spaces; distances and budgets count the characters
    of that form, start and end the code points of the text itself. Null and blank texts and items match nothing,
    items below 100 / percent characters match exactly, equal rows give equal rows, an empty benchmark gives none.
    Documents are not shuffled. Items reach the executors in blocks of bounded size: one block searches all
    documents, several search those that one pass finds to hold the beginning of any piece.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance long, start long, end long"
    n, known = heads(blocks(benchmark, item_col, item_text_col), percent)
    if n > 1:
        slim = durable(map_arrow(slim, _likely(spark.sparkContext.broadcast(known), "text", True), slim.schema))
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, item_col, item_text_col):
        out = out.unionByName(map_arrow(slim, _search(spark.sparkContext.broadcast(block), percent), schema))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, percent: int = ERROR_PERCENT, text_col: str = "text") -> DataFrame:
    """docs, in its own columns, without the rows that hold an item. Null and blank texts stay, and all rows if there are no items."""
    spark: SparkSession = docs.sparkSession
    n, known = heads(blocks(benchmark, "item_id", "text"), percent)
    rest = None
    if n > 1:
        shared = spark.sparkContext.broadcast(known)
        rest = map_arrow(docs, _likely(shared, text_col, False), docs.schema)
        docs = map_arrow(docs, _likely(shared, text_col, True), docs.schema)
    for block in blocks(benchmark, "item_id", "text"):
        docs = map_arrow(docs, _clean(spark.sparkContext.broadcast(block), percent, text_col), docs.schema)
        docs = durable(docs) if n > 1 else docs  # or a task would hold the automata of all blocks at once
    return docs if rest is None else docs.unionByName(rest)
