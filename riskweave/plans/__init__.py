"""Registered queries over the given tables."""

from riskweave.plans import control_queries, feature_queries, metric_queries, scoring_queries, store_queries, stream_queries  # noqa: F401
from riskweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
