"""All named queries of the library."""

from gleanery.plans import queries_copy, queries_defaults, queries_findings, queries_identity, queries_insights, queries_items, queries_jobs, queries_sources, queries_streaming  # noqa: F401
from gleanery.plans.registry import ORACLES, QUERIES  # noqa: F401
