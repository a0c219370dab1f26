"""End-to-end jobs (ingest, back-fill, training frame) and the stand-in queries."""
