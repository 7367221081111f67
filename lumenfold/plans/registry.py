"""All registered queries of the library's own operators, with their DuckDB SQL."""

from __future__ import annotations

from . import audit_queries, bookkeeping_queries, corpus_queries, gain_queries, label_queries, metric_queries, raster_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (audit_queries, bookkeeping_queries, corpus_queries, gain_queries, label_queries, metric_queries, raster_queries):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
