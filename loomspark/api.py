"""Plain-Python entry points for single texts; columns go through ``functions``."""

from __future__ import annotations

from .functions import phonemes
from .functions.g2p import _SYMBOL, Frontend, default_lexicon
from .functions.persian import normalised_text as normalize

__all__ = ["Frontend", "normalize", "phonemize", "text_to_ids", "to_ipa"]


def phonemize(text: str) -> str:
    return Frontend()(normalize(text))["phonemes"]


def text_to_ids(text: str) -> list[int]:
    return Frontend()(normalize(text))["ids"]


def to_ipa(line: str) -> str:
    """A phoneme string for display."""
    return "".join(phonemes.IPA.get(s, "ˈ" if s == "1" else s) for s in _SYMBOL.findall(line))


def lexicon():
    return default_lexicon()
