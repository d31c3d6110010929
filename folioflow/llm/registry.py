"""The queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from folioflow.llm.q01_quality_rules import OP1_SQL, op1_quality_rules
from folioflow.llm.q02_html_extraction import op2_html_extraction
from folioflow.llm.q03_chat_formatting import OP3_SQL, op3_chat_formatting
from folioflow.llm.q04_ngram_join import OP4_SQL, op4_ngram_join
from folioflow.llm.q05_secret_scans import op5_secret_scans
from folioflow.llm.q06_url_filters import OP6_SQL, op6_url_filters
from folioflow.llm.q07_byte_bpe import op7_byte_bpe
from folioflow.llm.q08_decontamination import op8_decontamination
from folioflow.llm.q09_token_counts import op9_token_counts
from folioflow.llm.q10_pii import op10_pii


def queries() -> dict[str, Callable]:
    return {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_chat_formatting, op4_ngram_join, op5_secret_scans, op6_url_filters, op7_byte_bpe, op8_decontamination, op9_token_counts, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_chat_formatting": OP3_SQL, "op4_ngram_join": OP4_SQL, "op6_url_filters": OP6_SQL}
