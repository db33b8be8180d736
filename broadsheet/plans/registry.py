"""All queries of the core operators and their DuckDB twins."""

from __future__ import annotations

from . import aggregating, files, filtering, joining, modeling, ranking, reshaping, strings  # noqa: F401
from .base import ORACLE, QUERIES


def queries() -> dict:
    return QUERIES


def oracle_sql() -> dict:
    return ORACLE
