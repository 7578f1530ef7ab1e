"""Registered queries over the test tables, and their independent SQL."""

from minekit.catalog.oracles import oracle_sql
from minekit.catalog.queries import queries

__all__ = ["oracle_sql", "queries"]
