"""Registered queries over the key-value, cache, vector and workload operators, with their SQL."""

from __future__ import annotations

from siltstone.plans import cache_queries, kv_queries, other_queries, store_queries, vector_queries

_MODULES = (vector_queries, kv_queries, store_queries, cache_queries, other_queries)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.SQL.items()}
