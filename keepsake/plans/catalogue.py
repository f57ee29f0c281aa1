"""The registry of driver queries; importing the modules fills it."""

from __future__ import annotations

from . import conversation_queries, evaluation_queries, event_queries, fact_queries, reading_queries, retrieval_queries, text_queries, vector_queries  # noqa: F401
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
