"""The registered queries and their DuckDB equivalents."""

from millwright.plans import log_queries, model_queries, table_queries

_MODULES = (table_queries, model_queries, log_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
