"""Queries over the tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from .plans import cycle_queries, news_queries, service_queries, stream_queries, table_queries, text_queries

ALL = {**text_queries.QUERIES, **table_queries.QUERIES, **news_queries.QUERIES, **service_queries.QUERIES, **stream_queries.QUERIES, **cycle_queries.QUERIES}


def queries() -> dict:
    return {name: fn for name, (fn, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in ALL.items() if sql}
