"""The queries of the screening engine and the SQL they are checked against."""

from __future__ import annotations

from wardsieve.plans import image_queries, service_queries, table_queries, text_queries

_PARTS = (text_queries, table_queries, image_queries, service_queries)


def queries() -> dict:
    return {name: f for p in _PARTS for name, f in p.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in _PARTS for name, sql in p.ORACLES.items()}
