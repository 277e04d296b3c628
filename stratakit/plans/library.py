"""All queries of the engine."""

from __future__ import annotations

from stratakit.plans import aggregates, columns, composites, graphs, joins, relations
from stratakit.plans.registry import QUERIES, oracle_sql

SQL = oracle_sql()

__all__ = ["QUERIES", "SQL", "aggregates", "columns", "composites", "graphs", "joins", "relations"]
