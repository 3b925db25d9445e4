"""Every query on the generated tables, with the SQL that must give the same rows."""

from __future__ import annotations

from .plans import features, models, series  # noqa: F401  each registers its queries
from .plans.adapters import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
