"""Registered queries: each a Spark plan over the tables of a directory, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from importlib import import_module

#: Modules with ``QUERIES`` (name to callable) and ``ORACLE`` (name to DuckDB SQL).
MODULES = ["audit", "split", "vectors", "scoring", "metrics", "numerics", "language", "frontend", "golden"]


def _gathered(kind: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"{__name__}.{module}"), kind)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _gathered("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gathered("ORACLE")
