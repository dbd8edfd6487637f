"""All queries of the library and their SQL, by name."""

from __future__ import annotations

from . import accuracy, audits, consistency, gates, inference, scenes  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
