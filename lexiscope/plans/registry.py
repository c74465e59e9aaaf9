"""All registered queries by name."""

from __future__ import annotations

from lexiscope.plans import language_queries, model_queries, table_queries

REGISTRY = {**table_queries.QUERIES, **language_queries.QUERIES, **model_queries.QUERIES}
