"""Queries and oracle SQL of this subpackage, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

#: Query name to the module that holds a function of that name.
MODULES = {
    "op1_html": "op1_html",
    "op2_packing": "op2_packing",
    "op3_toxicity": "op3_toxicity",
    "op4_bpe": "op4_bpe",
    "op5_line_dedup": "op5_line_dedup",
    "op6_ann": "op6_ann",
    "op7_quality": "op7_quality",
    "op8_simhash": "op8_simhash",
    "op9_sharding": "op9_sharding",
    "op10_media": "op10_media",
}


def queries() -> dict:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
