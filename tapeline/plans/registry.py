"""All registered queries over market frames and their SQL."""

from __future__ import annotations

from . import core_queries, factor_queries, insight_queries, realtime_queries, strategy_queries

_MODULES = (core_queries, factor_queries, insight_queries, strategy_queries, realtime_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
