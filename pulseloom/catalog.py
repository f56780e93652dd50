"""One query per operator, by the operator's name, and its SQL."""

from __future__ import annotations

from .plans import label_queries, signal_queries

QUERIES = label_queries.QUERIES | signal_queries.QUERIES
ORACLE_SQL = label_queries.ORACLE_SQL | signal_queries.ORACLE_SQL
flagship = signal_queries.flagship
