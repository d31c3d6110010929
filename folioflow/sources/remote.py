"""Files that a document service of the network parses."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.sources import json_documents
from folioflow.sources.elements import _TYPES, SCHEMA, batched

#: The service's addresses.
CONVERT, HEALTH = "/v1/convert/file", "/health"


def healthy(url: str, timeout: float = 10) -> bool:
    """Whether the service answers."""
    try:
        with urllib.request.urlopen(url.rstrip("/") + HEALTH, timeout=timeout) as answer:
            return answer.status == 200
    except OSError:
        return False


def _form(name: str, content: bytes, fields: dict[str, str]) -> tuple[str, bytes]:
    mark = uuid.uuid4().hex
    name = name.replace("\\", "\\\\").replace('"', '\\"').replace("\r", " ").replace("\n", " ")
    parts = [f'--{mark}\r\nContent-Disposition: form-data; name="{k}"\r\n\r\n{v}\r\n'.encode() for k, v in fields.items()]
    file = f'--{mark}\r\nContent-Disposition: form-data; name="files"; filename="{name}"\r\nContent-Type: application/octet-stream\r\n\r\n'.encode()
    return f"multipart/form-data; boundary={mark}", b"".join(parts) + file + content + f"\r\n--{mark}--\r\n".encode()


def convert(url: str, name: str, content: bytes, retries: int = 2, timeout: float = 300, wait: float = 1, **options: str) -> str:
    """The JSON tree of one file. After a failure the service is asked again, each time after a longer wait; the last failure is raised as ValueError."""
    if not content:
        raise ValueError("empty file")
    kind, body = _form(name, content, {"to_formats": "json", "image_export_mode": "embedded", "do_ocr": "true", "table_mode": "accurate"} | options)
    for attempt in range(retries + 1):
        try:
            request = urllib.request.Request(url.rstrip("/") + CONVERT, body, {"Content-Type": kind}, method="POST")
            with urllib.request.urlopen(request, timeout=timeout) as answer:
                said = json.load(answer)
            if said.get("status") != "success":
                raise ValueError(f"status {said.get('status')}: {said.get('errors')}")
            return json.dumps(said["document"]["json_content"])
        except (OSError, ValueError, LookupError, TypeError, AttributeError) as e:
            fault = f"{type(e).__name__}: {e}"
        if attempt < retries:
            time.sleep(wait * (attempt + 1))
    raise ValueError(fault)


def read(files: DataFrame, url: str, retries: int = 2, timeout: float = 300, wait: float = 1, **options: str) -> tuple[DataFrame, DataFrame]:
    """(elements, faults) of files (doc_id, path, content) as the service at url parses them.

    faults (doc_id, path, error) has empty files and those that the service refuses each time. Both tables call the
    service when they are used: store the one that is used twice. Options go with each file as fields of its form.
    """

    def rows(doc: dict) -> list[tuple]:
        path = doc["path"] or ""
        try:
            found = json_documents.parse(convert(url, path, doc["content"] or b"", retries, timeout, wait, **options))
        except ValueError as e:
            return [(doc["doc_id"], *[None] * 8, path, str(e))]
        return [(doc["doc_id"], k, e.label, e.level, e.depth, e.layer, e.text, e.marker, e.language, path, None) for k, e in enumerate(found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = (doc for batch in batches for at in range(batch.num_rows) for doc in batch.slice(at, 1).to_pylist())
        return batched((row for doc in docs for row in rows(doc)), names, (*_TYPES, pa.string(), pa.string()))

    schema = SCHEMA + ", path string, error string"
    names = [f.split()[0] for f in schema.split(", ")]
    out = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).mapInArrow(run, schema)
    return out.where("error is null").drop("path", "error"), out.where("error is not null").select("doc_id", "path", "error")
