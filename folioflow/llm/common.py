"""What the corpus operators share: durable intermediate tables, joins of a checked size, word hashes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.operators.tables import durable, shared_folder

#: Rows of a broadcast side; a larger one takes part in a shuffled join.
BROADCAST_ROWS = 500_000
#: Copies of the small side of a salted join.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sized(right: DataFrame, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """right made durable, and whether it has few enough rows to be broadcast."""
    right = durable(right)
    return right, right.count() <= limit


def join_small(left: DataFrame, right: DataFrame, key: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """left join right on a column of the same name: broadcast if right's counted rows allow it, else shuffled.

    A shuffled left or semi join keeps left streamed, so that adaptive execution can split a hot key of left.
    """
    right, few = sized(right, limit)
    return left.join(F.broadcast(right) if few else right, key, how)


def join_salted(left: DataFrame, right: DataFrame, key: str, salt_by: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """left join right (few rows a key) on key, where one key may hold a third of left."""
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = left.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    return left.join(salted, [key, "_salt"], how).drop("_salt")


#: Bytes of a batch that are worked on at once; a longer row is worked on alone.
SLICE_BYTES = 4 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in the same order, in batches of about SLICE_BYTES: what a task holds depends on neither the length of texts nor Arrow's rows a batch."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Freed memory returns to the system: Spark's Python workers live on for other tasks, beside a JVM of fixed size."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one, it keeps its own rules
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow(run, schema) over small slices, whose memory is given back at the end of each task."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            give_back()

    return df.mapInArrow(bounded, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


class WordHashes(dict):
    """64-bit hashes of words, remembered for as long as they fit."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_MULTIPLY, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mixed(v: np.ndarray) -> np.ndarray:
    v = v ^ (v >> np.uint64(29))
    v = v * _MIX
    return v ^ (v >> np.uint64(32))


def shingle_hashes(words: list[bytes], width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; of the whole sequence if it is shorter than width."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    if n < width:
        width, h = n, h + np.uint64(n)  # a short sequence is no shingle of a longer one
    v = _mixed(h[: n - width + 1])
    for k in range(1, width):
        v = _mixed(v * _MULTIPLY + h[k : n - width + 1 + k])
    return np.unique(v)
