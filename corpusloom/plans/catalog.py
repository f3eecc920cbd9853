"""All queries over the test tables, and the SQL that they are held against."""

from __future__ import annotations

from corpusloom.plans.registry import ORACLE, QUERIES
from corpusloom.plans import aggregate_queries, filter_queries, function_queries, incremental_queries, join_queries, order_queries, source_queries, stream_queries, text_queries, window_queries  # noqa: F401, E402, I001

__all__ = ["ORACLE", "QUERIES"]
