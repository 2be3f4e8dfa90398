"""All queries over the log tables: each module adds its own."""

from tidelog.plans import file_queries  # noqa: F401
from tidelog.plans.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
