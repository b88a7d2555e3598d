"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ("curriculum", "packing", "transport", "quality_rules", "warc", "secrets", "ranking", "run_index", "seed_extend", "forest", "centroids", "personal", "phrases", "sql")


def _all(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"{__package__}.{name}"), kind, {})
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
