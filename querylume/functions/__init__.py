"""Column functions and ingest transforms."""
