"""Registered queries of the time-series operators."""

from .series_queries import QUERIES, SQL, anomalies

__all__ = ["QUERIES", "SQL", "anomalies"]
