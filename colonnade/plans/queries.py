"""All queries of the core library; importing the modules registers them."""

from colonnade.plans import match_queries, memory_queries, profile_queries, quality_queries, relate_queries, report_queries, retrieve_queries, select_queries, sqltext_queries  # noqa: F401
from colonnade.plans.registry import ORACLE, QUERIES  # noqa: F401
