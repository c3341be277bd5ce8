"""Corpus operators for training data. Nothing else in the library imports this subpackage."""

from coppice.llm.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
