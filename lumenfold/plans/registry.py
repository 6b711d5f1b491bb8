"""Every query by name, and its SQL twin where SQL can express it."""

from __future__ import annotations

from lumenfold.plans import answer_queries, graph_queries, search_queries, source_queries, text_queries  # noqa: F401
from lumenfold.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
