"""All queries over the driver's tables with the SQL they are checked against."""

from __future__ import annotations

from factloom.plans import complete, documents, evidence, knowledge, library, lifecycle, profiles, retrieval, search, series, structure, tables, text, whole  # noqa: F401  they enter their queries
from factloom.plans.registry import ORACLE_SQL, QUERIES

FLAGSHIP = "flagship_series_growth_conflicts"

__all__ = ["FLAGSHIP", "ORACLE_SQL", "QUERIES"]
