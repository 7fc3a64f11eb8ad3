"""The named queries of the library and, where SQL can say the same, the SQL."""

from __future__ import annotations

from lectern.plans import number_queries, table_queries, text_queries, voice_queries

_PARTS = (number_queries, text_queries, table_queries, voice_queries)
QUERIES: dict = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in _PARTS for name, sql in part.ORACLE_SQL.items()}
