"""Query op3: all conversations, formatted and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.chat_format import format_segments, read_loss, read_turns, text_part
from folioflow.llm.common import table

_CONTROL = r"\### Assistant: </turn> ok"


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments are digested on their own; only the digests' inputs of one conversation meet in a row, as its hash needs them in order."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_CONTROL).alias("text"))
    turns = rows.unionByName(extra).select("conv_id", "turn", "role", text_part(F.coalesce("text", F.lit(""))).alias("parts"))
    segments = format_segments(turns)
    said = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    part = segments.select("conv_id", "segment", "piece", F.size(read_turns(F.col("formatted"))).cast("long").alias("n"), said.alias("said"), F.array_join(read_loss(F.col("formatted"), F.col("loss_spans")), "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = part.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("segment", "piece", "said", "loss"))).alias("s"))
    loss, said = F.array_join(F.transform("s", lambda x: x["loss"]), ""), F.array_join(F.transform("s", lambda x: x["said"]), "")
    return whole.select("conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
             sum(21 + length(text) + length(role) + 3 * (length(text) - length(replace(text, '<', ''))) + 3 * (length(text) - length(replace(text, '>', ''))) + 4 * (length(text) - length(replace(text, '&', ''))) + 5 * (length(text) - length(replace(text, '"', '')))) AS formatted_chars
      FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars + 2 * n_turns AS BIGINT) AS formatted_chars FROM g
"""
