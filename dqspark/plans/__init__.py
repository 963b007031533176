"""Registered queries, each with the SQL that an oracle runs."""

from __future__ import annotations

import importlib

from .registry import QUERIES, SQL

MODULES = ("flagship", "histories", "analytics", "ruleplans", "tuning", "outcomes", "checks")


def queries():
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
