"""Secret scans: base patterns, and runs of characters that a Markov model of random strings explains better than one of identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns, by kind in the order in which ties are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats for each character by which the random model must be the better one.
MARGIN = 0.25

#: Parts of ordinary identifiers, paths and long words, for the labelled samples.
PARTS = "get set add remove update create delete find load save read write open close start stop user name file path list map key value index count size length time date type node tree item data string number table column row field record page document text word line block token cache queue worker thread task stage config option default error message handler service client server request response session account order price customer product description component container international responsibility transformation configuration implementation authentication".split()


def samples(spark: SparkSession, n: int = 1500) -> DataFrame:
    """(label, text): label 1 for random strings over several alphabets, 0 for identifiers in several styles. Both by rule."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest("r"))), r"\s", "")
    word = lambda k: F.element_at(F.array(*map(F.lit, PARTS)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    random = F.element_at(F.array(F.substr(base64, F.lit(1), F.lit(40)), F.substr(F.translate(base64, "+/", "-_"), F.lit(3), F.lit(32)), F.translate(F.upper(base64), "+/=", "XYZ"), F.regexp_replace(base64, "[^A-Za-z0-9]", "")), (F.pmod(i, F.lit(4)) + 1).cast("int"))
    camel = F.concat(word(1), F.initcap(word(2)), F.initcap(word(3)))
    year = F.concat(word(1), F.lit("-"), word(2), F.lit("-"), word(3), F.lit("-"), (F.pmod(F.xxhash64(i), F.lit(90)) + 10).cast("string"))
    ordinary = F.element_at(F.array(camel, F.concat_ws("_", word(1), word(2), word(3)), F.upper(F.concat_ws("_", word(1), word(2), word(3))), year, F.concat_ws("/", word(1), word(2), word(3)), F.concat(word(1), word(2), word(3))), (F.pmod(i, F.lit(6)) + 1).cast("int"))
    ids = spark.range(n)
    return ids.select(F.lit(1).alias("label"), random.alias("text")).unionByName(ids.select(F.lit(0).alias("label"), ordinary.alias("text")))


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratios random : identifier of each character after each other one, by add-half counts. Its size is fixed by the alphabet."""
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("k")
    pairs = labelled.where("length(text) > 1").select("label", "text", at).select("label", F.substr("text", F.col("k"), F.lit(1)).alias("a"), F.substr("text", F.col("k") + 1, F.lit(1)).alias("b"))
    counts = {(r.label, r.a, r.b): r["count"] for r in pairs.groupBy("label", "a", "b").count().collect()}
    total = {(label, a): sum(counts.get((label, a, b), 0) for b in ALPHABET) for label in (0, 1) for a in ALPHABET}
    p = lambda label, a, b: (counts.get((label, a, b), 0) + 0.5) / (total[label, a] + 0.5 * len(ALPHABET))
    return [math.log(p(1, a, b) / p(0, a, b)) for a in ALPHABET for b in ALPHABET]


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ratio(run: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio of a run's characters."""
    table = F.split(F.lit(",".join(f"{x:.5f}" for x in model)), ",").cast("array<double>")
    place = F.transform(F.filter(F.split(run, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    score = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p) - 1), F.lit(0.0), lambda s, k: s + F.element_at(table, (F.element_at(p, k) - 1) * len(ALPHABET) + F.element_at(p, k + 1)))
    return _let(place, score) / (F.length(run) - 1)


_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches that keep() accepts: lengths of what stands between them, and of themselves, add up."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_SPAN).alias("found"))

    def step(s, m):
        begin = s["at"] + F.length(m["gap"])
        end = begin + F.length(m["m"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        ok = m["m"].isNotNull() if keep is None else m["m"].isNotNull() & keep(m["m"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(s["found"], span)).otherwise(s["found"]).alias("found"))

    pieces = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    fold = F.aggregate(pieces, start, step, lambda s: s["found"])
    return F.when(text.rlike(pattern), fold).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """Spans (start, kind, end) of the base patterns, code points, end exclusive, by start and then kind."""
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12
    return F.sort_array(F.concat(_matches(text, ASSIGN, 0, value), _matches(text, ACCESS, 1), _matches(text, HEX, 2)))


def random_spans(text: Column, base: Column, model: list[float]) -> Column:
    """Spans of runs that the random model explains better by MARGIN a character, where no base span overlaps."""
    found = _matches(text, RUN, 3, lambda m: ratio(m, model) > MARGIN)
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) for each row: arrays of (start, kind, end). A null or empty text has none; each row is scanned alone."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    slim = slim.withColumn("base", base_spans(F.col("text")))
    return slim.select("doc_id", "base", F.sort_array(F.concat("base", random_spans(F.col("text"), F.col("base"), model))).alias("spans"))


def joined(spans: Column) -> Column:
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, model: list[float]) -> Column:
    """text with each span, or each group of overlapping spans, replaced by the kind of its first in brackets. Null stays null."""
    spans = _let(base_spans(text), lambda b: F.sort_array(F.concat(b, random_spans(text, b, model))))
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)

    def step(s, x):
        fresh = x["start"] >= s["at"]
        more = F.array(F.substr(text, (s["at"] + 1).cast("int"), (x["start"] - s["at"]).cast("int")), F.concat(F.lit("["), name(x["kind"]), F.lit("]")))
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(fresh, F.concat(s["out"], more)).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda s: F.concat(F.array_join(s["out"], ""), F.substr(text, (s["at"] + 1).cast("int"), F.length(text)))
    return _let(spans, lambda x: F.when(F.size(x) == 0, text).otherwise(F.aggregate(x, start, step, rest)))


def redact(docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs in its own columns, secrets replaced, and chars_col, where there is one, counted anew. No row goes."""
    model = train(samples(docs.sparkSession))
    out = docs.withColumn(text_col, redacted(F.col(text_col), model))
    if chars_col in docs.columns:
        kind = dict(docs.dtypes)[chars_col]
        out = out.withColumn(chars_col, F.when(F.col(text_col).isNull(), F.col(chars_col)).otherwise(F.length(text_col)).cast(kind))
    return out.select(docs.columns)
