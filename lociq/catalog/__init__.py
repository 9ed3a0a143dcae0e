"""Registered queries: domain-shaped views of the given tables, the library operator on top,
and the same result as plain SQL."""

from lociq.catalog import models, relational, samples, scalars, scans  # noqa: F401  (registers the queries)
from lociq.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
