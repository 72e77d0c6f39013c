"""All queries, by name."""

from inkveil.plans import chunked, more, old, packages, queries, wide
from inkveil.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "chunked", "more", "old", "packages", "queries", "wide"]
