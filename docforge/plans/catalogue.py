"""All named queries and the SQL that says the same."""

from docforge.plans import corpus, handles, relational  # noqa: F401  they register themselves
from docforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
