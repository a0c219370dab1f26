"""Structured Streaming jobs (K5: incremental upsert of landed files)."""
