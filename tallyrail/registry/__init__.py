"""Registered queries on the given tables, and their SQL."""

from tallyrail.registry import (  # noqa: F401
    basic_queries, dashboard_queries, report_queries, stored_queries, stream_queries)
from tallyrail.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
