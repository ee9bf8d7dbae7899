"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mixing", "packing", "simhash", "line_dedup", "toxicity", "quality", "ann", "substrings", "suffix_array", "pii"]


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"{__package__}.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("SQL")
