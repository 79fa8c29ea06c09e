"""All queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from glossa.plans import service_queries, source_queries, text_queries, vector_queries

QUERIES = {**vector_queries.QUERIES, **text_queries.QUERIES, **source_queries.QUERIES, **service_queries.QUERIES}
ORACLES = {**vector_queries.ORACLES, **text_queries.ORACLES, **source_queries.ORACLES, **service_queries.ORACLES}
