"""Queries over the driver's tables, by operator family."""

from . import cluster_queries, funnel_queries, profile_queries, taxonomy_queries  # noqa: F401
