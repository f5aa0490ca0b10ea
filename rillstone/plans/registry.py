"""All queries and their SQL."""

from .reference import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
