"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "texts", "corpus", "documents", "rules", "jobs", "records")


def collect(kind: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"quarry.plans.{name}"), kind)
    return found
