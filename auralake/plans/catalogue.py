"""All core queries and their SQL by name."""

from __future__ import annotations

from auralake.plans import problems, reference

QUERIES = dict(reference.QUERIES) | dict(problems.QUERIES)
ORACLE = dict(reference.ORACLE) | dict(problems.ORACLE)
