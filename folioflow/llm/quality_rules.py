"""Quality rules of documents and of their hosts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import BROADCAST_ROWS, durable, join_salted, map_arrow, sized, texts

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Rules that count for hosts only: symbols for each word, and share of lines that repeat an earlier one, in percent.
MAX_SYMBOL_PERCENT, MAX_DUP_LINE_PERCENT = 10, 30
#: A host is rejected if its shrunk failure rate of one rule is above this.
MAX_HOST_RATE = 0.8
#: All rules, the base ones first.
BASE_RULES, RULES = ("short", "repeats"), ("short", "repeats", "symbols", "dup_lines")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (those with a word) of a whole text; a null text has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # cuts at the six ASCII white space characters
    n = len(words)
    word_chars = len(text) - sum(map(text.count, "\t\n\x0b\x0c\r "))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip("\t\n\x0b\x0c\r ")]
    repeated = 0
    windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        times = Counter(windows)
        covered = bytearray(n)
        for k, w in enumerate(windows):
            if times[w] > 1:
                covered[k : k + WINDOW] = b"\1" * WINDOW
        repeated = sum(covered)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def failures(n_words: int, word_chars: int, n_symbols: int, n_dup_lines: int, n_repeat_words: int, n_lines: int) -> tuple[bool, bool, bool, bool]:
    """Which of RULES a text with these measures fails."""
    return n_words < MIN_WORDS, 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words, 100 * n_symbols > MAX_SYMBOL_PERCENT * n_words, 100 * n_dup_lines > MAX_DUP_LINE_PERCENT * n_lines


def base_fails(text: str | None) -> bool:
    return any(failures(*measure(text))[: len(BASE_RULES)])


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
_MEASURED = "doc_id long, host string, " + ", ".join([*(f"{m} long" for m in _MEASURES), *(f"{r} boolean" for r in RULES)])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(t) for t in texts(batch)]
        failed = [failures(*r) for r in rows]
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_MEASURES))] + [pa.array([r[k] for r in failed], pa.bool_()) for k in range(len(RULES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "host", *_MEASURES, *RULES])


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, rule, n, failed, rate): failure rates of each host in each rule, shrunk with a beta prior that is fitted to all hosts for that rule.

    The prior has the mean of all documents and the strength that the spread of the hosts' rates beyond binomial
    noise implies (method of moments, hosts weighted by documents); at least one and at most 10**6 documents strong.
    Documents are summed per task before the shuffle. Rows without a host have none.
    """
    hosts = judged.where("host is not null and host != ''").groupBy("host").agg(F.count("*").alias("n"), *(F.sum(F.col(r).cast("long")).alias(r) for r in RULES))
    hosts = hosts.select("host", "n", F.inline(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES))))
    prior = hosts.groupBy("rule").agg((F.sum("failed") / F.sum("n")).alias("m"), F.sum("n").alias("total"), F.count("*").alias("k"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("squares"))
    # squares - total m^2: the weighted variance between hosts; of it (k - 1) m (1 - m) is binomial noise
    noise = F.col("m") * (1 - F.col("m"))
    between = F.greatest((F.col("squares") - F.col("total") * F.col("m") * F.col("m") - (F.col("k") - 1) * noise) / F.col("total"), F.lit(0.0))
    strength = F.least(F.greatest(F.when(between > 0, noise / between - 1).otherwise(F.lit(1e6)), F.lit(1.0)), F.lit(1e6))
    out = hosts.join(F.broadcast(prior.select("rule", "m", strength.alias("strength"))), "rule")  # a row for each of RULES
    return out.select("host", "rule", "n", "failed", ((F.col("failed") + F.col("m") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("rate"))


def bad_hosts(judged: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host) of hosts whose shrunk rate of any rule is above max_rate."""
    return host_rates(judged).where(F.col("rate") > max_rate).select("host").distinct()


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row a document: doc_id, host, the measures, the rules that count for hosts only, base_failed, host_rejected, kept.

    A document is kept if it passes the base rules and its host's shrunk failure rate is at most max_rate in each of RULES. Documents
    without a host (null or empty) are judged by the base rules alone. Null, empty and blank texts have no words and
    fail. Equal rows give equal rows; an empty table gives none; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = durable(map_arrow(docs, _measured, _MEASURED)).withColumn("base_failed", F.col("short") | F.col("repeats"))
    bad, few = sized(bad_hosts(rows, max_rate).withColumn("rejected", F.lit(True)))
    out = rows.join(F.broadcast(bad), "host", "left") if few else join_salted(rows, bad, "host", ["doc_id"])
    rejected = F.coalesce(F.col("rejected"), F.lit(False))
    return out.select("doc_id", "host", *_MEASURES, F.col("symbols").alias("symbols_failed"), F.col("dup_lines").alias("dup_lines_failed"), "base_failed", rejected.alias("host_rejected"), (~F.col("base_failed") & ~rejected).alias("kept"))


def _passing(text_at: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not base_fails(t) for t in texts(batch, text_at)], pa.bool_()))

    return run


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """docs, in its own columns, without the rows that judge() would not keep. Rows are judged one by one, so equal ids don't matter."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    rows = durable(map_arrow(slim, _measured, _MEASURED).select("host", *RULES))
    bad, few = sized(bad_hosts(rows, max_rate).withColumnRenamed("host", "_rejected_host"), BROADCAST_ROWS)
    passing = map_arrow(docs, _passing(text_col), docs.schema)
    return passing.join(F.broadcast(bad) if few else bad, passing[host_col] == bad["_rejected_host"], "left_anti")
