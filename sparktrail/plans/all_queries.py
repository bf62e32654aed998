"""Imports every module that registers queries."""

from sparktrail.plans import q_norm, q_rules, q_sessions  # noqa: F401
from sparktrail.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
