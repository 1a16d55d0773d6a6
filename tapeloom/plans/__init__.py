"""Composed queries over the given tables."""

from tapeloom.plans import bar_queries, book_queries, clean_queries, eval_queries, label_queries, state_queries, tick_queries  # noqa: F401
from tapeloom.plans import stream_queries, table_queries  # noqa: F401, isort: skip (they share SQL of the ones above)
from tapeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
