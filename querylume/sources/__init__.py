"""Schemas, sources and sinks."""
