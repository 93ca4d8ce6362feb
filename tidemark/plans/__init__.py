"""Queries over the given tables, each with the SQL that gives the same rows."""

from . import incremental, monitors_queries, quality_history, rules_measures, sources_scalars
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "incremental", "monitors_queries", "quality_history", "rules_measures", "sources_scalars"]
