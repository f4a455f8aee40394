"""All registered queries and their SQL."""

from __future__ import annotations

from narrate_spark.plans import (
    job_queries,
    page_queries,
    plan_queries,
    stream_queries,
    text_queries,
    voice_queries,
)

_MODULES = (
    text_queries,
    page_queries,
    plan_queries,
    voice_queries,
    job_queries,
    stream_queries,
)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
