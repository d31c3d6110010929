"""Queries: a module each with QUERIES (name to function) and SQL (name to the same result in DuckDB's SQL)."""

from folioflow.plans import check_plans, document_plans, file_plans, legacy_plans, office_plans, page_plans, reader_plans, structure_plans, text_plans

QUERY_MODULES = [text_plans, structure_plans, document_plans, page_plans, office_plans, file_plans, reader_plans, check_plans, legacy_plans]
