"""Registered queries over the driver's tables, each with its SQL oracle."""

from tidemark.plans import analytics, ingest, material, views
from tidemark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "ingest", "material", "views"]
