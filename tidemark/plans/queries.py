"""All registered queries of the bar engine, with their DuckDB text."""

from . import bar_queries, data_queries, detail_queries, engine_queries, evidence_queries

QUERIES = bar_queries.QUERIES | engine_queries.QUERIES | data_queries.QUERIES | evidence_queries.QUERIES | detail_queries.QUERIES
SQL = bar_queries.SQL | engine_queries.SQL | data_queries.SQL | evidence_queries.SQL | detail_queries.SQL
