"""All registered queries of this subpackage and the SQL each is held against."""

from __future__ import annotations

from . import queries as _queries


def queries() -> dict:
    return dict(_queries.QUERIES)


def oracle_sql() -> dict:
    return dict(_queries.SQL)
