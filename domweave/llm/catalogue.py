"""All queries of this package."""

from domweave.llm import queries  # noqa: F401
from domweave.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
