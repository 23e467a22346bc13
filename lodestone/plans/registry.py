"""Registry of queries over the driver's tables: name to callable, and name to SQL."""

from __future__ import annotations

from lodestone.plans import builds, experiments, growing, model, review, tables, wider  # noqa: F401 (those without tables of their own add to model and tables)

QUERIES: dict = model.QUERIES | tables.QUERIES | growing.QUERIES | builds.QUERIES
ORACLE_SQL: dict[str, str] = model.ORACLE_SQL | tables.ORACLE_SQL | growing.ORACLE_SQL | builds.ORACLE_SQL
