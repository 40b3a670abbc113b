"""Queries by name, with their DuckDB oracles."""

from __future__ import annotations

from rankweave.plans import name_queries, profile_queries, ranking_queries, state_queries, text_queries
from rankweave.plans.catalog import ORACLES, QUERIES

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES", "name_queries", "profile_queries", "ranking_queries", "state_queries", "text_queries"]

FLAGSHIP = QUERIES["flagship_rank_shortlist"]
