"""All queries of the library and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from .queries import experiences, governance, graphs, inference, records, relational, shapes, texts, vectors

_MODULES = [vectors, relational, graphs, texts, records, shapes, experiences, governance, inference]
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
