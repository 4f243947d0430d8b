"""Named queries over the given tables, each with its SQL definition."""

from kpiloom.catalog import commerce, models, relational, storage, tables  # noqa: F401
from kpiloom.catalog.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
