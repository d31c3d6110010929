"""Query op6: verdicts on all pages' urls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioflow.llm.common import table
from folioflow.llm.url_filter import judge

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP6_SQL = rf"""
WITH RECURSIVE p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), {_LOWER}) AS host, coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path, html FROM pages),
j AS (SELECT page_id, host, path, html, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
v AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS says FROM j),
links AS (SELECT host AS src, unnest(list_distinct([translate(x, {_LOWER}) FOR x IN regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s<>]+)', 1)])) AS dst FROM v WHERE host <> '' AND html IS NOT NULL),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY src, dst),
h AS (SELECT host, count(*) AS n, count(*) FILTER (says = 'allow') AS a, count(*) FILTER (says = 'block') AS b FROM v WHERE host <> '' GROUP BY host),
seeds AS (SELECT CASE WHEN b > a THEN 'distrust' ELSE 'trust' END AS kind, host FROM h WHERE 2 * greatest(a, b) > n),
sums AS (SELECT kind, count(*) AS k FROM seeds GROUP BY kind),
ways AS (SELECT 'trust' AS kind, src, dst, n FROM e UNION ALL SELECT 'distrust', dst, src, n FROM e),
free AS (SELECT * FROM ways WHERE NOT EXISTS (SELECT 1 FROM seeds WHERE seeds.host = src AND seeds.kind <> ways.kind)),
steps AS MATERIALIZED (SELECT kind, src AS host, dst, n / sum(n) OVER (PARTITION BY kind, src) AS w FROM free
        UNION ALL SELECT 'share', dst, src, n / all_links FROM (SELECT *, sum(n) OVER (PARTITION BY src) AS all_links FROM e) WHERE src NOT IN (SELECT host FROM seeds)),
base AS MATERIALIZED (SELECT kind, host, (1 - CAST(0.85 AS DOUBLE)) / k AS rank FROM seeds JOIN sums USING (kind) UNION ALL SELECT 'share', host, CAST(1 AS DOUBLE) FROM seeds WHERE kind = 'distrust'),
least AS MATERIALIZED (SELECT kind, max(rank) * CAST(0.0001 AS DOUBLE) AS least FROM base GROUP BY kind),
added AS (SELECT kind, host, rank, false AS done FROM base
        UNION ALL SELECT kind, host, rank, bool_and(rank <= least) OVER () FROM
            (SELECT kind, dst AS host, sum(rank * w * CAST(0.85 AS DOUBLE)) AS rank FROM added JOIN steps USING (kind, host) WHERE NOT done GROUP BY kind, dst) JOIN least USING (kind)),
sides AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust, coalesce(sum(rank) FILTER (kind = 'share'), 0) AS share FROM added GROUP BY host),
bad AS (SELECT host FROM sides WHERE distrust > trust * (1 + CAST(1e-9 AS DOUBLE)) AND share >= CAST(0.1 AS DOUBLE))
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""
