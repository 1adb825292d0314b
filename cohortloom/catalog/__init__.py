"""Registered queries: a Spark form and, where SQL can say it, the equivalent ANSI SQL."""

from . import causal, clinical, relational, sampling, statistics
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "causal", "clinical", "relational", "sampling", "statistics"]
