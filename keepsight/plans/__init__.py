"""Registered queries: the operators over the driver's tables, each with its SQL check."""

from keepsight.plans.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
