"""Query op10: all documents with pseudonyms in place of personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm.common import table
from folioflow.llm.pii import KINDS, pseudonymise

#: Where the session has no key, a public one, for test data only.
KEY_SETTING, DEMO_KEY = "spark.folioflow.pii.key", "folioflow-demo-key"


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, DEMO_KEY))
    kinds = F.transform("found", lambda f: f["kind"])
    counts = [F.size(F.array_remove(kinds, k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    counts = [(F.size("found") - n).alias(f"n_{name}") for n, name in zip(counts, KINDS, strict=True)]
    return out.select("doc_id", "text", *counts)
