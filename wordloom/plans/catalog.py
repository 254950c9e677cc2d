"""Registry of the library's queries and their SQL."""

from __future__ import annotations

from . import audit_queries, han_queries, learning_queries, match_queries, quality_queries, text_queries

FLAGSHIP = "q_safe_replacements"
_MODULES = (text_queries, match_queries, learning_queries, quality_queries, audit_queries, han_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
