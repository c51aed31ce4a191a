"""Every registered query of the event engine, and the SQL it is checked against."""

from __future__ import annotations

from .plans import condition_queries, event_queries, function_queries, ingest_queries, lookup_queries
from .plans.register import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "condition_queries", "event_queries", "function_queries", "ingest_queries", "lookup_queries"]
