"""Every registered query of the engine, and the SQL that checks it."""

from __future__ import annotations

from tidemark.plans import chain, decode, evaluation, facts, feedback, graph, listing, market, sources, stream  # noqa: F401
from tidemark.plans.bindings import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
