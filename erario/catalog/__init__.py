"""Registered queries and their oracle SQL."""

from erario.catalog import archives, checking, loading, measures, tables  # noqa: F401  (register)
from erario.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
