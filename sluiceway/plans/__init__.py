"""Whole jobs and the registered queries."""

from sluiceway.plans import batch_queries, stream_queries  # noqa: F401
from sluiceway.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
