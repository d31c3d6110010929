"""Queries over plain text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions.text import fixed_chunks, sanitize, strip


def content_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as one text element, cut for retrieval after 900 code points."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", strip(sanitize(F.col("text"))).alias("text"))
    out = docs.select("doc_id", F.posexplode(fixed_chunks(F.col("text"), 900)).alias("chunk_no", "content"))
    return out.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "content", F.length("content").cast("long").alias("n_runes"))


QUERIES = {"content_chunks": content_chunks}

SQL = {
    "content_chunks": r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '||chr(133)||chr(160)||chr(12288)) AS t FROM documents),
c AS (SELECT doc_id, unnest(range(0, CAST(ceil(length(t) / 900.0) AS BIGINT))) AS chunk_no, t FROM d)
SELECT doc_id, chunk_no, substring(t, chunk_no * 900 + 1, 900) AS content, length(substring(t, chunk_no * 900 + 1, 900)) AS n_runes FROM c
"""
}
