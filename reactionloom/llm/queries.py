"""All queries of this subpackage and their SQL."""

from __future__ import annotations

from reactionloom.llm import text_queries, value_queries

MODULES = (value_queries, text_queries)

QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
