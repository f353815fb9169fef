"""Registered queries and their SQL."""

from accordant.plans import queries_documents, queries_entities, queries_facts, queries_review  # noqa: F401
from accordant.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
