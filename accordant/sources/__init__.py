"""Readers, ingest and sinks."""
