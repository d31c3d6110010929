"""E-mail messages as elements: subject, head lines, the best body and the names of attachments."""

from __future__ import annotations

import email
import email.policy
import functools

from pyspark.sql import DataFrame

from folioflow.sources import elements, html_pages
from folioflow.sources.elements import Element

#: Messages within messages that are read; a deeper one is an error of its file.
MAX_DEPTH = 16
#: Parsed head lines that are kept, and their greatest length.
KEPT, KEPT_CHARS = 512, 1_000


@functools.lru_cache(KEPT)
def _head_line(name: str, value: str):
    return email.policy.default.header_fetch_parse(name, value)


class _Policy(email.policy.EmailPolicy):
    """The default policy, but a line of the head is parsed once, not each time that a part's type, form or file name is asked for."""

    def header_fetch_parse(self, name, value):
        return (_head_line if len(value) <= KEPT_CHARS else super().header_fetch_parse)(name, value)


_POLICY = _Policy()


def _worth(part) -> int:
    """Of the forms of one text: nested parts before HTML before all others."""
    return 3 if part.is_multipart() else 2 if part.get_content_type() == "text/html" else 1


def _body(part, depth: int) -> list[Element]:
    kind = part.get_content_type()
    if part.get_content_disposition() == "attachment" or (part.get_filename() and kind != "message/rfc822"):
        return [Element("text", f"{part.get_filename() or 'attachment'} ({kind})")]
    if kind == "message/rfc822":
        inner = part.get_payload()
        if inner and depth >= MAX_DEPTH:
            raise ValueError("messages nested too deep")
        return _message(inner[0], depth + 1) if inner else []
    if kind == "multipart/alternative":
        forms = list(part.iter_parts())
        return _body(forms[max(range(len(forms)), key=lambda k: (_worth(forms[k]), k))], depth) if forms else []
    if part.is_multipart():
        return [e for p in part.iter_parts() for e in _body(p, depth)]
    if part.get_content_maintype() != "text":
        return [Element("text", f"attachment ({kind})")]
    text = part.get_content().replace("\r\n", "\n")
    if kind == "text/html":
        return html_pages.parse(text)
    return [Element("text", p.strip()) for p in text.split("\n\n") if p.strip()]


def _message(message, depth: int) -> list[Element]:
    head = [Element("title", str(message["Subject"]).strip())] if message["Subject"] else []
    return head + [Element("text", f"{k}: {message[k]}") for k in ("From", "To", "Date") if message[k]] + _body(message, depth)


def parse(text: str) -> list[Element]:
    return _message(email.message_from_string(text, policy=_POLICY), 0) if text.strip() else []


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return elements.read(docs, parse, id_col, text_col)
