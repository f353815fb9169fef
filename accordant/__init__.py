"""Grounded reconciliation of document piles as Spark jobs."""
