"""All plans by name, with their DuckDB SQL."""

from __future__ import annotations

from . import details, facts, more, readers, rollups, signals  # noqa: F401  registers the queries
from .roles import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
