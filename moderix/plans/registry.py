"""All registered queries of the reference's operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from moderix.plans import decision_queries, evaluation_queries, panel_queries, record_queries, text_queries

MODULES = (panel_queries, evaluation_queries, decision_queries, text_queries, record_queries)
QUERIES: dict[str, Callable] = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
