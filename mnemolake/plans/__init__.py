"""Registered queries over the tables, with SQL for those that SQL can express."""

from . import memory_queries, text_queries

QUERIES = memory_queries.QUERIES | text_queries.QUERIES
ORACLE_SQL = memory_queries.ORACLE_SQL | text_queries.ORACLE_SQL
