"""The library's queries over the given tables, and SQL for the same rows."""

from . import following, loads, quality, scalars, scans  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
