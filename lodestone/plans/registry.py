"""Every registered query and the SQL it is compared with."""

from __future__ import annotations

from lodestone.plans import base, chunking_queries, cleaning_queries, enrichment_queries, generation_queries, model_queries, retrieval_queries, source_queries, state_queries  # noqa: F401

FLAGSHIP = "hybrid_search"


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
