"""All registered queries of the core and the SQL each is held against."""

from __future__ import annotations

from . import engine_queries, graph_queries, lookup_queries, orphan_queries, search_queries, source_queries, stream_queries

MODULES = [lookup_queries, graph_queries, search_queries, stream_queries, orphan_queries, source_queries, engine_queries]


def queries() -> dict:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
