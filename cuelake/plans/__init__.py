"""Registered queries."""

from cuelake.plans import queries, record_queries  # noqa: F401
