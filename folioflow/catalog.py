"""All queries over the driver's tables, and their SQL."""

from __future__ import annotations

from folioflow.plans import QUERY_MODULES


def queries() -> dict:
    return {name: run for module in QUERY_MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in QUERY_MODULES for name, sql in module.SQL.items()}
