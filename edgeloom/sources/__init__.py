"""Readers, sinks and the ingest recipes of the source databases."""
