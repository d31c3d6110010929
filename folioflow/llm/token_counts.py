"""Token counts under a unigram vocabulary: Viterbi that carries a score and a number of pieces, no path."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import map_arrow, texts

SPACE = "▁"
#: Fixed value of the tokenizer: an unknown character costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments that a task remembers, and the length up to which it does; more than this are forgotten together.
REMEMBERED, REMEMBERED_CHARS = 400_000, 64


def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in id order from a tokenizer model file, by its wire format: field 1 of the model, fields 1 and 2 of a piece."""
    raw = open(path, "rb").read()

    def fields(data: bytes) -> Iterator[tuple[int, bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            out = shift = 0
            while True:
                b = data[at]
                at += 1
                out |= (b & 127) << shift
                shift += 7
                if b < 128:
                    return out

        while at < len(data):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number().to_bytes(8, "little")
                continue
            size = number() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size

    out = []
    for field, body in fields(raw):
        if field == 1:
            own = dict(fields(body))
            out.append((own.get(1, b"").decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0))
    return out


class Counter:
    """Counts a text's tokens as the unigram tokenizer with byte fallback does, spaces as U+2581 and one put before the text.

    Ties: among best paths to a place the one with the earlier last start wins. Scores are doubles, as in the
    tokenizer. A piece holds U+2581 or a newline only at its start or alone (checked), so no piece reaches over the
    start of a segment and segments can be counted apart, each distinct one once.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        known = {p: s for p, s in pieces if p}
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and p != "\n") for p in known):
            raise ValueError("a piece reaches over a segment's start")
        self.machine = ahocorasick.Automaton()
        for p, s in known.items():
            self.machine.add_word(p, (len(p), s))
        self.machine.make_automaton()
        self.longest = max(map(len, known), default=0)
        if not all(f"<0x{b:02X}>" in known for b in range(256)):
            raise ValueError("the vocabulary has no byte pieces")
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.seen: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """(tokens, score) of the best path over one segment; a character without a piece of its own may also be its bytes.

        Matches come in the order of their ends, the longest, which starts first, first. Only the places that a piece
        may still start at are held, so a long segment takes no more memory than a short one.
        """
        size = self.longest + 1
        score, count = [0.0] * size, [0] * size
        matches = self.machine.iter(text)
        last, found = next(matches, (-1, None))
        for end in range(1, len(text) + 1):
            best, tokens, single = None, 0, False
            while last == end - 1:
                length, s = found
                take = score[(end - length) % size] + s
                if best is None or take > best:
                    best, tokens = take, count[(end - length) % size] + 1
                single = single or length == 1
                last, found = next(matches, (-1, None))
            if not single:
                take = score[(end - 1) % size] + self.unknown
                if best is None or take > best:
                    best, tokens = take, count[(end - 1) % size] + len(text[end - 1].encode("utf-8", "surrogatepass"))
            score[end % size], count[end % size] = best, tokens
        return count[len(text) % size], score[len(text) % size]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        seen, tokens, score = self.seen, 0, 0.0
        for m in self.segments.finditer(SPACE + text.replace(" ", SPACE)):
            part = m[0]
            if (found := seen.get(part)) is None:
                found = self.segment(part)
                if len(part) <= REMEMBERED_CHARS:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[part] = found
            tokens += found[0]
            score += found[1]
        return tokens, score


def _counted(pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(pieces.value)
        for batch in batches:
            rows = [counter.count(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return run


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, score) for each row: tokens and score of the best path over the whole text.

    The vocabulary is a file of a fixed size, broadcast once. Null and empty texts have no tokens; ids may be null,
    equal rows give equal rows, an empty table gives none, other columns are not read. Nothing is shuffled. A task holds
    one slice of texts, a copy of the text that it counts, and a bounded number of short segments.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary_path))
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(slim, _counted(pieces), "doc_id long, n_tokens long, score double")
