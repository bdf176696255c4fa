"""All queries of the core, and their SQL twins."""

from __future__ import annotations

from vellum.plans import check_queries, more_queries, nested_queries, prepare_queries, score_queries, twins

FLAGSHIP = "agg_02_role_prf"
_MODULES = [score_queries, prepare_queries, more_queries, nested_queries, check_queries]
QUERIES = {name: f for module in _MODULES for name, f in module.QUERIES.items()}
ORACLES = {name: sql for module in [*_MODULES, twins] for name, sql in module.ORACLES.items()}
