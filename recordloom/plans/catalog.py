"""The registry of queries and of their SQL twins."""

from __future__ import annotations

from recordloom.plans import queries_batch, queries_corpus, queries_files, queries_values

PARTS = (queries_values, queries_batch, queries_corpus, queries_files)
QUERIES = {name: f for part in PARTS for name, f in part.query.queries.items()}
ORACLE_SQL = {name: sql for part in PARTS for name, sql in part.query.sql.items()}
