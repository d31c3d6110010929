"""Recognisers that the caller supplies, asked page by page and checked."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import bound, clean_recognised, garbage_ratio, is_blank, strip
from folioflow.operators.pages import recognised_fault
from folioflow.operators.tables import durable
from folioflow.operators.visual import CELLS, page_faults

#: Times that a page is asked for.
ATTEMPTS = 2
#: Rows that go to the recogniser's task at once: pages carry their bytes.
SLICE_ROWS = 16


def _asked(pages: DataFrame, hook: Callable[[dict], str]) -> DataFrame:
    """pages with answer, null where the recogniser raised an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part, answers = batch.slice(at, SLICE_ROWS), []
                for request in part.to_pylist():
                    try:
                        answers.append(hook(request) or "")
                    except Exception:  # noqa: BLE001 - whatever a caller's recogniser raises counts as no answer
                        answers.append(None)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], names=[*part.schema.names, "answer"])

    return pages.mapInArrow(run, pages.withColumn("answer", F.lit(None).cast("string")).schema)


def _checked(text: Column) -> Column:
    """A cleaned answer and its fault. They are stored with the answer: each later step would check it anew."""
    existing = strip(F.coalesce("existing", F.lit("")))
    worse = ~is_blank(existing) & (garbage_ratio(text) >= garbage_ratio(existing))
    fault = F.when(F.col("answer").isNull(), "failed").otherwise(F.coalesce(recognised_fault(text), F.when(worse, "worse")))
    return F.struct(text.alias("text"), fault.alias("fault"))


def recognised(pages: DataFrame, hook: Callable[[dict], str], attempts: int = ATTEMPTS) -> DataFrame:
    """(doc_id, page_no, text, attempt, fault) of pages (doc_id, page_no, existing, and whatever else the recogniser reads).

    hook gets a page's columns as a dict with attempt (from 1) and feedback (the fault of the answer before, null at
    first) and returns a text. Answers are cleaned and checked; a page with a fault is asked for again, attempts times
    in all, and its last fault is kept with a null text. Where a page has an existing text, the answer must hold a smaller share of
    garbage, else its fault is "worse" and it isn't asked for again. Each answer is stored as it comes, so no page is asked for twice
    because of a later step or a lost executor. A task keeps SLICE_ROWS pages at a time. An empty table gives none.
    """
    asked = pages.withColumn("attempt", F.lit(1)).withColumn("feedback", F.lit(None).cast("string"))
    done = None
    for k in range(1, attempts + 1):
        said = durable(_asked(asked, hook).withColumn("_said", bound(clean_recognised(F.col("answer")), _checked)))
        said = said.withColumns({"_text": F.col("_said.text"), "_fault": F.col("_said.fault")}).drop("_said")
        again = F.col("_fault").isNotNull() & (F.col("_fault") != "worse") & F.lit(k < attempts)
        out = said.where(~again).select("doc_id", "page_no", F.when(F.col("_fault").isNull(), F.col("_text")).alias("text"), "attempt", F.col("_fault").alias("fault"))
        done = out if done is None else done.unionByName(out)
        asked = said.where(again).withColumn("feedback", F.col("_fault")).withColumn("attempt", F.lit(k + 1)).drop("answer", "_text", "_fault")
    return done


#: What a visual model says of a page's items.
ITEMS = f"array<struct<label:string,text:string,level:int,confidence:double,l:double,t:double,r:double,b:double,rows:long,cols:long,turn:int,cells:{CELLS}>>"


def visual_items(pages: DataFrame, hook: Callable[[dict], str], attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(items, faults) of pages (page, width, height, and whatever else the model reads): what a visual model finds on them.

    hook gets a page as for recognised and returns a JSON list of items (label, text, level, confidence, l, t, r, b with the
    origin at the bottom, and for tables rows, cols, turn, cells). A page whose answer has a fault is asked for again with
    that fault, attempts times in all. items (page, ord, ...) are those of pages without a fault, faults (page, attempt,
    fault) the others' last ones. Pages must differ in page; answers are stored as they come.
    """
    asked = pages.withColumn("attempt", F.lit(1)).withColumn("feedback", F.lit(None).cast("string"))
    items = faults = None
    for k in range(1, attempts + 1):
        said = _asked(asked, hook).withColumn("_items", F.from_json("answer", ITEMS))
        said = durable(said)
        found = said.select("page", F.posexplode("_items").alias("ord", "_i")).select("page", "ord", "_i.*")
        found = found.withColumn("cells", F.coalesce("cells", F.array().cast(CELLS)))
        checked = page_faults(found, said.select("page", "width", "height")).withColumnRenamed("fault", "_fault")
        said = durable(said.join(checked, "page", "left").withColumn("_fault", F.when(F.col("answer").isNull(), "failed").when(F.col("_items").isNull(), "no JSON").otherwise(F.col("_fault"))))
        good = found.join(said.where("_fault is null").select("page"), "page", "left_semi")
        bad = said.where("_fault is not null")
        last = bad.where(F.lit(k == attempts)).select("page", "attempt", F.col("_fault").alias("fault"))
        items, faults = (good, last) if items is None else (items.unionByName(good), faults.unionByName(last))
        asked = bad.withColumn("feedback", F.col("_fault")).withColumn("attempt", F.lit(k + 1)).drop("answer", "_items", "_fault")
    return items, faults
