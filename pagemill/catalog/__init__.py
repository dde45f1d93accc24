"""Registered queries: each operator over the given tables, with its SQL twin where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES

# One module per group of operators; importing it fills the two registries.
GROUPS = ("text", "merge", "values", "registry", "library", "nodes", "books", "language", "quality", "streams")

for _group in GROUPS:
    import_module(f".{_group}", __name__)

__all__ = ["QUERIES", "ORACLES"]
