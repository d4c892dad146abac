"""Registered queries, one per operator, and their check SQL."""

from __future__ import annotations

import importlib

from resonance.catalog.common import QUERIES, SQL

MODULES = ("scalars", "extraction", "relations", "description", "texts", "learning", "explanation", "streams")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"resonance.catalog.{name}")


def registered_queries() -> dict:
    _load()
    return dict(QUERIES)


def registered_sql() -> dict:
    _load()
    return dict(SQL)
