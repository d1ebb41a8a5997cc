"""Operators of a training-data pipeline, their queries and their SQL."""

from tastemap.llm.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
