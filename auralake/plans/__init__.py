"""Queries of the core operators and the SQL they are checked against."""
