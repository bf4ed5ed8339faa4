"""Queries over the given tables, one or more for each operator, with the SQL that must give the same rows."""

from . import documents, extras, jobs, logs, search, texts
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "documents", "extras", "jobs", "logs", "search", "texts"]
