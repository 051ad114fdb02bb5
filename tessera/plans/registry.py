"""The library's registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import documents, pages, pipeline, quality, records, search

MODULES = (search, documents, pipeline, records, pages, quality)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
