"""All registered queries."""

from domweave.plans import analysis_queries, job_queries, page_queries, quality_queries, run_queries, stream_queries  # noqa: F401
from domweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
