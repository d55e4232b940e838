"""Registered queries over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from importlib import import_module

from ledgerloom.catalog.registry import ORACLES, QUERIES

for _name in ("scans", "columns", "filters", "joins", "aggregates", "sequences", "products", "models", "streams"):
    import_module(f"ledgerloom.catalog.{_name}")

__all__ = ["ORACLES", "QUERIES"]
