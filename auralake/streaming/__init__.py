"""Structured Streaming counterparts of the incremental behaviours."""
