"""Phoneme strings: symbols, tokens, ids, stress and linker, as native expressions."""

from __future__ import annotations

from .dialect import Dialect

# The symbol inventory in id order, and its IPA.
SPECIALS = ("_", "^", "$", "#")
CONSONANTS = ("p", "b", "t", "d", "k", "g", "q", "'", "f", "v", "s", "z", "sh", "zh", "x", "h", "ch", "j", "m", "n", "l", "r", "y")
VOWELS = ("A", "i", "u", "a", "e", "o")
MARKERS = ("1", " ", "-", "|", "||", "?", "!")
SYMBOLS = (*SPECIALS, *CONSONANTS, *VOWELS, *MARKERS)
IPA = dict(zip((*CONSONANTS, *VOWELS), ("p", "b", "t", "d", "k", "ɡ", "ɢ", "ʔ", "f", "v", "s", "z", "ʃ", "ʒ", "χ", "h", "t͡ʃ", "d͡ʒ", "m", "n", "l", "ɾ", "j", "ɒː", "iː", "uː", "æ", "e", "o")))
PAD, BOS, EOS, UNKNOWN = 0, 1, 2, 3
#: Sonority classes, for the order of consonants in a cluster.
SONORITY = {
    "p": 1, "b": 1, "t": 1, "d": 1, "k": 1, "g": 1, "q": 1, "'": 1, "ch": 1, "j": 1,
    "f": 2, "v": 2, "s": 2, "z": 2, "sh": 2, "zh": 2, "x": 2, "h": 2,
    "m": 3, "n": 3, "l": 4, "r": 4, "y": 5,
}


def _array(d: Dialect, values) -> str:
    inner = ", ".join("chr(39)" if v == "'" else f"'{v}'" for v in values)
    return f"array({inner})" if d.spark else f"[{inner}]"


def tokens(d: Dialect, x: str) -> str:
    """Symbols by longest match, unknown characters as ``#``."""
    raw = d.extract_all(x, r"(?s)\|\||[szc]h|.")
    known = f"array_position({_array(d, SYMBOLS)}, s) > 0" if d.spark else f"list_contains({_array(d, SYMBOLS)}, s)"
    return d.map(raw, "s", f"CASE WHEN {known} THEN s ELSE '#' END")


def ids(d: Dialect, symbols: str) -> str:
    position = f"CAST(array_position({_array(d, SYMBOLS)}, s) AS INT)" if d.spark else f"list_position({_array(d, SYMBOLS)}, s)"
    return d.map(symbols, "s", f"coalesce(nullif({position}, 0) - 1, {UNKNOWN})")


def text_of(d: Dialect, numbers: str) -> str:
    """Back to a string; padding and sentence marks are dropped."""
    return d.join(d.map(d.keep(numbers, "i", f"i > {EOS}"), "i", d.at(_array(d, SYMBOLS), "i + 1")), "")


def interspersed(d: Dialect, numbers: str) -> str:
    """A blank before, between and after the ids."""
    pairs = d.map(numbers, "i", d.array("i", PAD))
    flat = f"flatten({pairs})"
    return f"concat(array({PAD}), {flat})" if d.spark else f"list_concat([{PAD}], {flat})"


def encoded(d: Dialect, x: str) -> str:
    """Ids with blanks between, sentence marks outside them."""
    inner = interspersed(d, ids(d, tokens(d, x)))
    return f"concat(array({BOS}), {inner}, array({EOS}))" if d.spark else f"list_concat(list_concat([{BOS}], {inner}), [{EOS}])"


def linker(d: Dialect, x: str) -> str:
    """The linker after a word: ``y`` first where it ends in a vowel."""
    return f"concat({x}, CASE WHEN {d.has(x, '[Aiuaeo]$')} THEN 'y-' ELSE '-' END)"


def vowels(d: Dialect, x: str) -> str:
    return f"CAST(length({d.sub(x, '[^Aiuaeo]', '')}) AS BIGINT)"


def stressed(d: Dialect, x: str, nth: str) -> str:
    """A stress mark before the n-th vowel, counted from 0 and clamped to those there are; none without vowels."""
    place = f"greatest(0, least({nth}, {vowels(d, x)} - 1))"
    cut = f"(CASE WHEN {place} = 0 THEN {d.extract(x, '^([^Aiuaeo]*)', 1)} WHEN {place} = 1 THEN {d.extract(x, '^([^Aiuaeo]*[Aiuaeo][^Aiuaeo]*)', 1)} WHEN {place} = 2 THEN {d.extract(x, '^((?:[^Aiuaeo]*[Aiuaeo]){2}[^Aiuaeo]*)', 1)} ELSE {d.extract(x, '^((?:[^Aiuaeo]*[Aiuaeo]){3}[^Aiuaeo]*)', 1)} END)"
    return f"(CASE WHEN {vowels(d, x)} = 0 THEN {x} ELSE concat({cut}, '1', substring({x}, CAST(length({cut}) AS INT) + 1)) END)"
