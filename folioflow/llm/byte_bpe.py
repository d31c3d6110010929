"""Byte-level BPE by a global shuffle of distinct words; positions travel as dictionary codes of bounded chunks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, texts

#: Bounds of a chunk: characters of text, and distinct words. A longer text is a chunk of its own.
CHUNK_CHARS, CHUNK_WORDS = 48_000_000, 1_500_000
#: Texts, and characters after which no more follow, of one row of positions.
GROUP_TEXTS, GROUP_CHARS = 256, 2_000_000
#: Parts of the vocabulary that are encoded apart: one for so many characters of input, within these bounds.
BUCKET_CHARS, LEAST_BUCKETS, MOST_BUCKETS = 64_000_000, 64, 16_384
#: Characters of input for each task that reassembles texts.
TASK_CHARS = 32_000_000
#: Words that a task remembers; more than this are forgotten together, and encoded again where they come back.
REMEMBERED = 1_000_000

_ROW = "kind int, chunk long, part int, doc_ids array<long>, data binary"
_NAMES = ["kind", "chunk", "part", "doc_ids", "data"]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _packed(*arrays: np.ndarray, tail: bytes = b"") -> bytes:
    head = np.array([len(arrays), *(len(a) for a in arrays)], np.uint32).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a, np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays) + tail, 3)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    k = int.from_bytes(raw[:4], "little")
    sizes = np.frombuffer(raw, np.uint32, k, 4)
    at, out = 4 + 4 * k, []
    for n in sizes.tolist():
        out.append(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T.copy().view(np.uint32).reshape(n))
        at += 4 * n
    return out, raw[at:]


class _Codes(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _rows(kind: int, chunk: int, part: list[int], doc_ids: list, data: list[bytes]) -> pa.RecordBatch:
    n = len(data)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([chunk] * n, pa.int64()), pa.array(part, pa.int32()), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(data, pa.binary())], names=_NAMES)


def _letters(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _words_of(codes: _Codes, chunk: int, buckets: int) -> pa.RecordBatch:
    """A row for each bucket with the chunk's distinct words of it: steps between their codes, lengths, letters."""
    known = list(map(_letters, codes))
    bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in known), np.int64, len(known))
    parts, data = [], []
    for b in np.unique(bucket).tolist():
        own = np.flatnonzero(bucket == b)
        mine = [known[k] for k in own.tolist()]
        parts.append(b)
        data.append(_packed(np.diff(own, prepend=0), np.array(list(map(len, mine))), tail=b"".join(mine)))
    return _rows(0, chunk, parts, [None] * len(parts), data)


def _split_texts(pattern: str, positions: bool, buckets: int):
    """Explodes texts chunk by chunk. positions: rows of kind 1, each with some texts' words in order, as codes; else rows of kind 0 with the distinct words.

    Codes number a chunk's words as they first occur, so both forms agree as long as a task gets the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern).findall
        codes, chars, chunk, part = _Codes(), 0, TaskContext.get().partitionId() << 24, 0
        ids, found, check, size = [], [], xxhash.xxh3_64(), 0

        def group():
            lengths = np.fromiter(map(len, found), np.uint32, len(found))
            return _rows(1, chunk, [part], [ids], [_packed(np.concatenate(found) if found else np.empty(0, np.uint32), lengths, tail=check.digest())])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                text = text or ""
                full = codes and (chars + len(text) > CHUNK_CHARS or len(codes) > CHUNK_WORDS)
                if ids and (full or len(ids) >= GROUP_TEXTS or size + len(text) > GROUP_CHARS):
                    yield group()
                    ids, found, check, size, part = [], [], xxhash.xxh3_64(), 0, part + 1
                if full:
                    if not positions:
                        yield _words_of(codes, chunk, buckets)
                    codes, chars, chunk = _Codes(), 0, chunk + 1
                words = split(text)
                chars += len(text)
                if positions:
                    ids.append(doc_id)
                    found.append(np.fromiter(map(codes.__getitem__, words), np.uint32, len(words)))
                    check.update(_letters(text))
                    size += len(text)
                else:
                    for w in dict.fromkeys(words):
                        codes[w]
        if ids:
            yield group()
        if codes and not positions:
            yield _words_of(codes, chunk, buckets)

    return run


_held: list = []


def _single(ranks: dict[bytes, int]):
    """The function that encodes one word: built once for a worker's tasks with the same ranks, and only where there are words."""
    if not _held or _held[0] is not ranks:
        _held[:] = [ranks, tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})]  # all of a word is one piece
    encode_ordinary = _held[1].encode_ordinary
    return lambda word: encode_ordinary(word.decode("utf-8", "surrogatepass"))


def _encode_words(ranks):
    """Rows of kind 0 with each word's token ids for its letters; a word that many chunks have is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, {}
        for batch in batches:
            single, data = _single(ranks.value), []
            for part, blob in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if part != bucket:
                    bucket, known = part, {}
                (step, length), letters = _unpacked(blob)
                ids, at = [], 0
                for n in length.tolist():
                    word = letters[at : at + n]
                    at += n
                    if (code := known.get(word)) is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        code = known[word] = single(word)
                    ids.append(code)
                data.append(_packed(step, np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter((i for w in ids for i in w), np.uint32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(data, pa.binary())], names=_NAMES)

    return run


def _spelled(parts: list[list[np.ndarray]], token: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of a chunk: all ids, then for each code where its own start, how many they are, and the bytes that they decode to."""
    none = np.empty(0, np.int64)
    codes = np.concatenate([none, *(np.cumsum(step) for step, _, _ in parts)])
    lengths = np.concatenate([none, *(n for _, n, _ in parts)])
    ids = np.concatenate([none, *(i for _, _, i in parts)]).astype(np.int32)
    by, starts = np.argsort(codes), np.cumsum(lengths) - lengths
    lengths, starts = lengths[by], starts[by]
    listed = [token[i] for i in ids.tolist()]
    return ids, starts, lengths, [b"".join(listed[s : s + n]) for s, n in zip(starts.tolist(), lengths.tolist(), strict=True)]


def _reassemble(ranks):
    """Texts' token ids by position, and the bytes that the token table gives back for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, chunk, parts, words = {}, None, [], None
        for batch in batches:
            token = token or {i: b for b, i in ranks.value.items()}
            for kind, c, doc_ids, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3, 4)), strict=True):
                if c != chunk:
                    chunk, parts, words = c, [], None
                arrays, tail = _unpacked(blob)
                if kind == 0:
                    parts.append(arrays)
                    continue
                if words is None:
                    words, parts = _spelled(parts, token), []
                ids, starts, lengths, spelled = words
                seq, texts_words = arrays[0].astype(np.int64), arrays[1].astype(np.int64)
                if len(seq) and seq.max() >= len(spelled):
                    raise RuntimeError("the two scans of a chunk differ: read the texts from a table")
                n = lengths[seq]
                ends = np.cumsum(n)
                values = ids[np.repeat(starts[seq] - (ends - n), n) + np.arange(int(n.sum()))]
                cut = np.cumsum(texts_words)
                offsets = np.concatenate([[0], np.concatenate([[0], ends])[cut]]).astype(np.int32)
                listed = [spelled[k] for k in seq.tolist()]
                decoded = [b"".join(listed[e - w : e]) for e, w in zip(cut.tolist(), texts_words.tolist(), strict=True)]
                if xxhash.xxh3_64_digest(b"".join(decoded)) != tail:
                    raise RuntimeError("the two scans of a chunk differ: read the texts from a table")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)), pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) for each row: the token ids of the whole text, and the bytes that they decode to.

    1. Texts are exploded into words (matches of pattern) with their positions. A task keeps the positions of a
       bounded chunk of texts as codes into the chunk's distinct words, and sends each distinct word once.
    2. Distinct words are shuffled by a hash into buckets, whose number grows with the input, and each is encoded once,
       however many chunks have it (again where a bucket has more than REMEMBERED).
    3. Ids return to their chunk, and texts are reassembled by position; the token-byte table decodes the ids.

    The texts are scanned twice, for words and for positions, and a task's number names its chunks: docs must give the
    same rows in the same partitions each time, as tables and their filters do; put the result of a join or of a random
    order into a table first. Each chunk's decoded bytes are checked against its texts' hash, so another order is an
    error and no wrong result. The characters are counted in a scan of their own before that.
    Null and empty texts have no ids. Equal rows give equal rows, ids may be null, other columns are not read. Special
    tokens have no part in it, an empty table gives no rows. The ranks are a vocabulary file: a broadcast of a fixed size.
    """
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chars = slim.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets = min(max(chars // BUCKET_CHARS, LEAST_BUCKETS), MOST_BUCKETS)
    words = map_arrow(map_arrow(slim, _split_texts(pattern, False, buckets), _ROW).repartition("part").sortWithinPartitions("part"), _encode_words(ranks), _ROW)
    places = map_arrow(slim, _split_texts(pattern, True, buckets), _ROW)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), chars // TASK_CHARS)
    # places stand first in the union, so their tasks have the numbers that the scan for words has
    met = places.unionByName(words).repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind", "part")
    return map_arrow(met, _reassemble(ranks), "doc_id long, ids array<int>, decoded binary")
