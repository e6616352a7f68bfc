"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from ..session import shipped
from . import detail_queries, graph_queries, member_queries, online_queries, pair_queries, reader_queries, record_queries, search_queries, text_queries, upkeep_queries

_MODULES = [text_queries, pair_queries, graph_queries, reader_queries, upkeep_queries, record_queries, member_queries, online_queries, search_queries, detail_queries]


def queries():
    return {name: shipped(f) for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql():
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
