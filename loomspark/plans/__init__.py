"""Queries over the driver's tables, one or more for each operator."""

from loomspark.plans import curation, knowledge, relations, scans, scores  # noqa: F401
from loomspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
