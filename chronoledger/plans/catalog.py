"""Every registered query with its DuckDB statement."""

from __future__ import annotations

from . import gate_queries, history_queries, job_queries, selection_queries, statements_history, statements_logs, table_queries  # noqa: F401 (two of them register statements)
from .sqltext import duckdb_text, spark_query
from .statements import FOUND

FLAGSHIP = "jn12_asof_history"


def queries() -> dict:
    return {name: spark_query(s) for name, s in FOUND.items()} | gate_queries.QUERIES | history_queries.QUERIES | job_queries.QUERIES | selection_queries.QUERIES | table_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: duckdb_text(s) for name, s in FOUND.items()} | gate_queries.SQL | history_queries.SQL | job_queries.SQL | selection_queries.SQL | table_queries.SQL
