"""All queries of the package by name, and the SQL that states the same results."""

from __future__ import annotations

from pagewright.plans import booked, dated, detailed, files, grouped, joined, ordered, reviewed, scalars, settled  # noqa: F401  they register their queries
from pagewright.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
