"""Queries of the training-data problems, and SQL where it can state them."""

from __future__ import annotations

from vellum.llm import dedup_queries, text_queries, token_queries, toxic_queries

_MODULES = [dedup_queries, text_queries, token_queries, toxic_queries]
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
