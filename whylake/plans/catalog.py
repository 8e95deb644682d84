"""All registered queries."""

from whylake.plans import answer_queries, evidence_queries, history_queries, notes_queries, session_queries  # noqa: F401
from whylake.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
