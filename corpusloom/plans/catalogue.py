"""All queries over the tables, with their SQL."""

from __future__ import annotations

from corpusloom.plans import layer_queries, report_queries, sequence_queries, table_queries, text_queries, voice_queries
from corpusloom.plans.registry import Query

_PARTS = (text_queries.Q, table_queries.Q, sequence_queries.Q, voice_queries.Q, report_queries.Q, layer_queries.Q)


def queries() -> dict[str, Query]:
    return {k: v for p in _PARTS for k, v in p.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for p in _PARTS for k, v in p.sql.items()}
