"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.common import BROADCAST_ROWS, WordHashes, durable, join_salted, join_small, map_arrow, shingle_hashes, sized, texts
from folioflow.llm.components import components

#: Counters of the corpus-wide frequency sketch, which orders n-grams from rare to frequent.
SKETCH_BITS = 20
SKETCH_PARTS = 16
#: Columns with more documents than this are multiplied in tiles rather than as pairs.
DENSE_COLUMN = 128
#: Documents on each side of a tile, and columns of one dense product.
TILE_ROWS, TILE_COLUMNS = 1500, 4096
#: Entries of the sets on each side of a tile, on average: long documents make smaller tiles.
TILE_ENTRIES = 1_000_000
#: Sets that a task remembers so as not to send them twice; others are sent again and meet in the shuffle.
SEEN = 250_000
#: A sketch counter beyond this many times the mean, and this many occurrences, marks n-grams whose columns are never sorted in one task.
HOT_TIMES, HOT_LEAST = 8, 2_000_000


def _words(text: str | None) -> list[bytes]:
    """bytes.lower touches A-Z alone and bytes.split cuts at the six ASCII white space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _signature(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).astype(np.int64))


def _sets(width: int):
    """doc rows (kind 0: doc_id, n, node) and, at the end of each task, its part of the frequency sketch (kind 1: part, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            ids, found = batch.column(0), [shingle_hashes(_words(t), width, hashes) for t in texts(batch)]
            if full := [h for h in found if len(h)]:
                counts += np.bincount((np.concatenate(full) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(found), pa.int32()), ids, pa.array(map(len, found), pa.int64()), pa.array([_signature(h) if len(h) else None for h in found], pa.int64()), pa.nulls(len(found), pa.binary())], names=["kind", "doc_id", "n", "node", "counts"]
            )
        if counts.any():
            parts = [zstandard.compress(p.tobytes(), 1) for p in np.split(counts, SKETCH_PARTS)]
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.array([1] * k, pa.int32()), pa.array(range(k), pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(parts, pa.binary())], names=["kind", "doc_id", "n", "node", "counts"])

    return run


def _sum_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            c = np.frombuffer(zstandard.decompress(blob), np.int64)
            total[part] = total[part] + c if part in total else c
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([c.tobytes() for c in total.values()], pa.binary())], names=["part", "counts"])


def _sketch(rows: DataFrame) -> np.ndarray:
    """2**SKETCH_BITS counters of all n-gram occurrences: 8 MB, however large the corpus is."""
    summed = rows.where("kind = 1").select(F.col("doc_id").alias("part"), "counts").repartition(SKETCH_PARTS, "part").mapInArrow(_sum_sketch, "part long, counts binary")
    parts = {r.part: np.frombuffer(bytes(r.counts), np.int64) for r in summed.collect()}
    empty = np.zeros((1 << SKETCH_BITS) // SKETCH_PARTS, np.int64)
    return np.concatenate([parts.get(k, empty) for k in range(SKETCH_PARTS)])


def _prefix(h: np.ndarray, order: np.ndarray, percent: int) -> np.ndarray:
    """The rarest n - ceil(percent * n / 100) + 1 n-grams: two linked sets share one of them at least."""
    keep = len(h) + (-percent * len(h) // 100) + 1
    return h[np.lexsort((h, order[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]]


def _incidence(width: int, percent: int, sketch, least: int, hot_least: int, hot_times: float):
    """Entries (kind, gram, n, node) of the prefix columns, kind 1 for hot ones; within a task a repeated set counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, order, seen = WordHashes(), sketch.value, set()
        hot = order > max(hot_least, hot_times * float(order.mean()))
        for batch in batches:
            grams, sizes, nodes = [], [], []
            for text in texts(batch):
                h = shingle_hashes(_words(text), width, hashes)
                if len(h) < least or (node := _signature(h)) in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(node)
                grams.append(p := _prefix(h, order, percent))
                sizes.append(np.full(len(p), len(h), np.int32))
                nodes.append(np.full(len(p), node, np.int64))
            if grams:
                g = np.concatenate(grams)
                kind = hot[(g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(g.astype(np.int64)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(nodes))], names=["kind", "gram", "n", "node"])

    return run


def _products(percent: int, dense: int):
    """Of sorted incidence entries: the pairs of each sparse column (kind 0) and the entries of dense and hot columns (kind 1)."""
    names = ["kind", "x", "y", "nx", "ny"]

    def rows(kind, *columns):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(c) for c in columns)], names=names)

    def column_pairs(g, n, d):
        start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        length = np.diff(np.r_[start, len(g)])
        for size in np.unique(length[(length > 1) & (length <= dense)]):
            i, j = np.triu_indices(size, 1)
            own = start[length == size]
            for at in range(0, len(own), step := max(1, 200_000 // len(i))):
                base = own[at : at + step, None]
                a, b = (base + i).ravel(), (base + j).ravel()
                fits = percent * n[b].astype(np.int64) <= 100 * n[a]  # sorted by size: b is the larger set
                a, b = a[fits], b[fits]
                low = d[a] < d[b]
                x, y = np.where(low, a, b), np.where(low, b, a)
                if len(x):
                    yield rows(0, d[x], d[y], n[x], n[y])
        many = np.repeat(length > dense, length)
        if many.any():
            yield rows(1, g[many], d[many], n[many], n[many])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_dense = [np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)], None
        for batch in batches:
            if k := int(np.count_nonzero(batch.column(0).to_numpy(zero_copy_only=False))):  # they come last
                g, n, d = (batch.column(c).to_numpy(zero_copy_only=False)[-k:] for c in (1, 2, 3))
                yield rows(1, g, d, n, n)
                batch = batch.slice(0, batch.num_rows - k)
            g, n, d = (np.concatenate([h, batch.column(k + 1).to_numpy(zero_copy_only=False)]) for k, h in enumerate(held))
            if len(g) == 0:
                continue
            keep = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]  # copies of a set that came from several tasks
            g, n, d = g[keep], n[keep], d[keep]
            if open_dense is not None and (k := int(np.searchsorted(g != open_dense, True))):
                yield rows(1, g[:k], d[:k], n[:k], n[:k])
                g, n, d = g[k:], n[k:], d[k:]
            if len(g) == 0:
                held = [g, n, d]
                continue
            tail = int(np.flatnonzero(np.r_[True, g[1:] != g[:-1]])[-1])
            if len(g) - tail > dense:
                open_dense = g[tail]
                yield rows(1, g[tail:], d[tail:], n[tail:], n[tail:])
                held = [g[:0], n[:0], d[:0]]
            else:
                open_dense, held = None, [g[tail:], n[tail:], d[tail:]]
            if tail:
                yield from column_pairs(g[:tail], n[:tail], d[:tail])
        if len(held[0]):
            yield from column_pairs(*held)

    return run


def _whole_sets(width: int):
    """(node, grams): each task's first text of each node, as sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            nodes, blobs = [], []
            for text in texts(batch):
                h = shingle_hashes(_words(text), width, hashes)
                if len(h) and (node := _signature(h)) not in seen:
                    if len(seen) < SEEN:
                        seen.add(node)
                    nodes.append(node)
                    blobs.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], names=["node", "grams"])

    return run


def _linked(overlap, nx, ny, percent: int):
    return 100 * overlap >= percent * (nx + ny - overlap)


def _verify(percent: int):
    """Pairs of whole sets whose exact overlap links them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for x, y, a, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if _linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def tile_links(nodes: np.ndarray, classes: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between different classes of the tile, one for each union they cause: overlap counts accumulate over column blocks."""
    if len(np.unique(classes)) < 2:
        return []
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(len(sets)), size)
    grams, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    overlap = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(shared.sum()), TILE_COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + TILE_COLUMNS])
        block = np.zeros((len(sets), TILE_COLUMNS), np.float32)
        block[row[lo:hi], column[lo:hi] - first] = 1
        overlap += block @ block.T
    pairs = []
    parent = {c: c for c in classes.tolist()}

    def find(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for i in range(len(sets)):
        o = overlap[i, i + 1 :].astype(np.int64)
        for j in np.flatnonzero(_linked(o, size[i], size[i + 1 :], percent) & (classes[i + 1 :] != classes[i])) + i + 1:
            a, b = find(classes[i].item()), find(classes[j].item())
            if a != b:
                parent[a] = b
                pairs.append((int(nodes[i]), int(nodes[j])))
    return pairs


def _tiles(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links():
            found = tile_links(np.array([r[3] for r in held]), np.array([r[4] for r in held]), [np.frombuffer(r[5], np.uint64) for r in held], percent) if held else []
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["u", "v"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[:3] != key:
                    yield links()
                    key, held = r[:3], []
                held.append(r)
        yield links()

    return run


def _classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """From rows (doc_id, text): slim rows (doc_id, n, node), and (node, root, first, same) of each node that is not alone.

    first is the smallest doc_id of a node's rows, null if none has one, and same the number of rows that have it.
    """
    rows = durable(map_arrow(docs, _sets(width), "kind int, doc_id long, n long, node long, counts binary"))
    slim = rows.where("kind = 0").select("doc_id", "n", "node")
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(rows))
    least = -(-percent // (100 - percent))  # smaller sets link with equal ones only, and with sets of this size or more

    entries = map_arrow(docs.select("text"), _incidence(width, percent, sketch, least, HOT_LEAST, HOT_TIMES), "kind int, gram long, n int, node long")
    # a hot column is spread over tasks by its nodes and leaves this stage whole, as entries of a dense column
    entries = entries.withColumn("salt", F.when(F.col("kind") == 1, F.col("node")).otherwise(0)).repartition("gram", "salt").sortWithinPartitions("kind", "gram", "n", "node").select("kind", "gram", "n", "node")
    block = map_arrow(entries, _products(percent, DENSE_COLUMN), "kind int, x long, y long, nx int, ny int")
    # rest: what may follow the prefix of the set whose prefix ends first
    need = F.ceil(percent * (F.col("nx") + F.col("ny")) / (100 + percent))
    rest = F.greatest(-F.floor(-percent * F.col("nx") / 100), -F.floor(-percent * F.col("ny") / 100)) - 1
    found = durable(block.groupBy("kind", "x", "y", "nx", "ny").agg(F.count("*").alias("c")).where((F.col("kind") == 1) | (F.col("c") + rest >= need)))
    dense = found.where("kind = 1").select(F.col("x").alias("gram"), F.col("y").alias("node"), F.col("nx").alias("n"))

    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)))
    hubs = durable(dense.groupBy("gram", band.alias("band")).agg(F.min("node").alias("hub")))
    few = hubs.count() <= BROADCAST_ROWS
    spokes = dense.withColumn("band", band).join(F.broadcast(hubs) if few else hubs, ["gram", "band"]).where("node != hub").select(F.col("hub").alias("x"), F.col("node").alias("y"))
    pairs = durable(found.where("kind = 0").select("x", "y").unionByName(spokes).distinct())
    wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).unionByName(dense.select("node")).distinct()
    whole = join_small(map_arrow(docs.select("text"), _whole_sets(width), "node long, grams binary"), wanted, "node", "left_semi", BROADCAST_ROWS)
    whole = durable(whole.groupBy("node").agg(F.first("grams").alias("grams")))

    def verified(some: DataFrame) -> DataFrame:
        both = some.join(whole.select(F.col("node").alias("x"), F.col("grams").alias("a")), "x").join(whole.select(F.col("node").alias("y"), F.col("grams").alias("b")), "y")
        return durable(map_arrow(both.select("x", "y", "a", "b"), _verify(percent), "u long, v long"))

    # each set meets its smallest partner first; of the other pairs, only those between different classes are left to verify
    ends = pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y")))
    first = ends.groupBy("x").agg(F.min("y").alias("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    links = verified(first)
    classes = components(links)
    root = lambda side: classes.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))
    others = pairs.join(root("x"), "x", "left").join(root("y"), "y", "left").where("rx is null or ry is null or rx != ry").select("x", "y")
    more = verified(others.join(first, ["x", "y"], "left_anti"))
    if not more.isEmpty():
        links = links.unionByName(more)
        classes = components(links)

    if not dense.isEmpty():
        classed = durable(dense.join(classes, "node", "left").select("gram", "node", "n", F.coalesce("root", "node").alias("class")))
        open_columns = classed.groupBy("gram").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.count("*").alias("m"), F.sum("n").alias("entries")).where("a != b").select("gram", F.greatest(F.ceil(F.col("m") / TILE_ROWS), F.ceil(F.col("entries") / TILE_ENTRIES)).cast("int").alias("blocks"))
        tile = classed.join(open_columns, "gram").withColumn("k", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        tile = tile.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("gram", F.least("k", "l").alias("i"), F.greatest("k", "l").alias("j"), "node", "class")
        tile = tile.join(whole, "node").select("gram", "i", "j", "node", "class", "grams").repartition("gram", "i", "j").sortWithinPartitions("gram", "i", "j")
        more = durable(map_arrow(tile, _tiles(percent), "u long, v long"))
        if not more.isEmpty():
            classes = components(links.unionByName(more))

    rows = slim.where("node is not null").groupBy("node", "doc_id").agg(F.count("*").alias("c"))
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id")
    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.sum("c").alias("c"), F.min_by("c", by_id).alias("same")).join(classes, "node", "left")
    return slim, durable(nodes.where("c > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root"), "first", "same"))


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row: similarity classes under 100 * overlap >= percent * union.

    1. Each text becomes its set of distinct word shingles as 64-bit hashes; texts with the same set are one node.
    2. Columns of the incidence matrix are ordered from rare to frequent by a sketch over all documents (any order
       gives the same links), and only the prefix columns of each set are multiplied: a linked pair shares one.
    3. The product accumulates overlap counts of pairs column by column. Pairs whose sizes, or whose count plus all
       that may follow the prefixes, cannot reach the bound are discarded. The rest are verified on whole sets, each
       set's smallest partner first: pairs inside a class that is already joined need no set of their own.
    4. Columns of more than DENSE_COLUMN nodes never become pairs of rows, and columns that the sketch calls hot never
       meet in one task. Each node meets the column's smallest node; where several classes are left, tiles of the
       column are multiplied densely and give one link a union.
    5. The links' connected components, and copies of equal sets, take the smallest doc_id.

    Null, empty and blank texts have no shingles and are linked with nothing; their component_id is their own doc_id.
    Equal rows give equal rows, an empty table none. A null doc_id is never the smallest. Other columns are not read.
    Two sets share a 64-bit hash by chance once in about 10**19 pairs.
    """
    slim, nodes = _classes(_slim(docs, id_col, text_col), width, percent)
    least_id = nodes.groupBy("root").agg(F.min("first").alias("component"))
    classed = nodes.join(least_id, "root").select("node", "component")
    out = join_small(slim, classed, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _with_node(width: int, text_at: str, names: list[str]):
    """The rows with the hash of their set as a last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = (shingle_hashes(_words(t), width, hashes) for t in texts(batch, text_at))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_signature(h) if len(h) else None for h in sets], pa.int64())], names=names)

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """docs in its own columns, with one row of each similarity class: the one with the smallest doc_id.

    Rows are told apart by their texts, not by their ids: rows that share a doc_id but not a class each stand for
    their own. A null doc_id counts as greater than all others. Rows of one class that share the smallest doc_id too
    leave one of them: of those with the smallest set hash, any one. Rows without shingles (null, empty or blank texts)
    are in no class and stay. An empty table gives none; docs must have a text column of strings, and may have others.
    """
    _, nodes = _classes(_slim(docs, id_col, text_col), width, percent)
    by_id = F.struct(F.col("first").isNull(), "first", "node")
    chosen = nodes.groupBy("root").agg(F.min_by("node", by_id).alias("chosen"))
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # no column of docs starts with it
    names = {c: f"{own}{c}" for c in ("node", "chosen", "first", "same")}
    fate = nodes.join(chosen, "root").select(F.col("node").alias(names["node"]), (F.col("node") == F.col("chosen")).alias(names["chosen"]), F.col("first").alias(names["first"]), F.col("same").alias(names["same"]))
    schema = T.StructType([*docs.schema.fields, T.StructField(names["node"], T.LongType())])
    marked = map_arrow(docs, _with_node(width, text_col, schema.names), schema)
    fate, few = sized(fate)
    out = marked.join(F.broadcast(fate), names["node"], "left") if few else join_salted(marked, fate, names["node"], [id_col])
    out = out.where(F.col(names["chosen"]).isNull() | (F.col(names["chosen"]) & F.col(id_col).cast("long").eqNullSafe(F.col(names["first"]))))
    several = F.coalesce(F.col(names["same"]), F.lit(1)) > 1
    if fate.where(F.col(names["chosen"]) & (F.col(names["same"]) > 1)).isEmpty():
        return out.select(docs.columns)
    return out.where(~several).unionByName(out.where(several).dropDuplicates([names["node"]])).select(docs.columns)
