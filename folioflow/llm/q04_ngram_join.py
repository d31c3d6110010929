"""Query op4: similarity classes of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import table
from folioflow.llm.ngram_join import ngram_components


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (SELECT r, n, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS s FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
sets AS MATERIALIZED (SELECT DISTINCT r, s FROM windows WHERE s IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.r < b.r GROUP BY a.r, b.r),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r, r AS other FROM d UNION SELECT reach.r, ways.b FROM reach JOIN ways ON ways.a = reach.other)
SELECT d.doc_id, CAST(coalesce(any_value(sizes.n), 0) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM d JOIN reach ON reach.r = d.r JOIN d o ON o.r = reach.other LEFT JOIN sizes ON sizes.r = d.r GROUP BY d.r, d.doc_id
"""
