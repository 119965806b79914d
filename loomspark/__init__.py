"""Spark-first engine for speech-and-text corpora."""

from __future__ import annotations

from importlib import import_module


def __getattr__(name: str):
    """``normalize``, ``phonemize``, ``text_to_ids`` and ``Frontend``, loaded when first asked for."""
    if name in ("Frontend", "normalize", "phonemize", "text_to_ids", "to_ipa"):
        return getattr(import_module(".api", __name__), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
