"""Query op1: base measures and host verdicts of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import table
from folioflow.llm.quality_rules import judge


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
base AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM w GROUP BY r),
win AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS k FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM win WHERE k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
cov AS (SELECT r, count(DISTINCT i + s) AS n_repeat_words FROM rep, range(0, 5) AS t(s) GROUP BY r),
ln AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.r, doc_id, host, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
      FROM d LEFT JOIN base ON base.r = d.r LEFT JOIN cov ON cov.r = d.r LEFT JOIN dup ON dup.r = d.r),
j AS (SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats, 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m),
h AS (SELECT host, rule, count(*) AS n, count(*) FILTER (bad) AS failed FROM (UNPIVOT (SELECT host, short, repeats, symbols, dup_lines FROM j WHERE host <> '') ON short, repeats, symbols, dup_lines INTO NAME rule VALUE bad) GROUP BY host, rule),
p AS (SELECT rule, sum(failed) / sum(n) AS m, sum(n) AS total, count(*) AS k, sum(failed * failed / n) AS squares FROM h GROUP BY rule),
q AS (SELECT rule, m, greatest((squares - total * m * m - (k - 1) * m * (1 - m)) / total, 0) AS between_hosts FROM p),
s AS (SELECT rule, m, least(greatest(CASE WHEN between_hosts > 0 THEN m * (1 - m) / between_hosts - 1 ELSE 1e6 END, 1), 1e6) AS strength FROM q),
v AS (SELECT DISTINCT host, true AS host_rejected FROM h JOIN s ON s.rule = h.rule WHERE (failed + m * strength) / (n + strength) > 0.8)
SELECT doc_id, j.host, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines,
       symbols AS symbols_failed, dup_lines AS dup_lines_failed, short OR repeats AS base_failed, coalesce(host_rejected, false) AS host_rejected, NOT (short OR repeats) AND NOT coalesce(host_rejected, false) AS kept
FROM j LEFT JOIN v ON v.host = j.host
"""
