"""Persian text functions as native expressions: normalisation, tokens, breaks, keys.

Each builder takes a ``Dialect`` and an SQL expression and returns an expression, so the same
definition serves columns (``column``), SQL and the oracle. The whole order of normalisation is a
table of steps that ``normalised`` runs over a column and ``normalised_text`` over a single text.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .dialect import Dialect

SPARK = Dialect(True)
ZWNJ = "‌"

# Digits, letter unification, punctuation and break symbols.
PERSIAN_DIGITS, ARABIC_DIGITS, ASCII_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
LETTERS_FROM = "يىےكڪةؤئإأٲٵھۀۍې"
LETTERS_TO = "یییککهویااااههیی"
SIGNS_FROM = " ‐‑‒–—‘’"
SIGNS_TO = " -----''"
DELETED = "﻿‎‏"
DIACRITICS = "[ً-ٰٕۖ-ۭـ]"
TANWIN = "ً"
PUNCTUATION_FROM, PUNCTUATION_TO = "٪٬,;?", "%,،؛؟"
KEPT = "ء-ی،؛؟!.:()«»\"'\\- \t\n\x0b\f\r‌…"
BREAKS = {"،": "|", "؛": "|", ":": "|", "…": "|", "(": "|", ")": "|", ".": "||", "؟": "?", "!": "!"}


def column(builder, x: str | Column, *more) -> Column:
    """A builder applied to a column by name."""
    return F.expr(builder(SPARK, x, *more))


def _q(d: Dialect, s: str) -> str:
    return "'" + s.replace("'", "\\'" if d.spark else "''") + "'"


def digits(d: Dialect, x: str) -> str:
    return f"translate({x}, '{PERSIAN_DIGITS + ARABIC_DIGITS}', '{ASCII_DIGITS * 2}')"


def unify(d: Dialect, x: str) -> str:
    """Arabic letter forms to Persian ones, dashes and quotes to plain ones, marks of direction deleted (``composed`` goes before)."""
    kept = f"translate({x}, {_q(d, LETTERS_FROM + SIGNS_FROM + '“”' + DELETED)}, {_q(d, LETTERS_TO + SIGNS_TO + chr(34) * 2)})"
    return kept


def tanwin(d: Dialect, x: str) -> str:
    return f"replace(replace(replace({x}, 'ا{TANWIN}', 'ان'), '{TANWIN}ا', 'ان'), '{TANWIN}', 'ن')"


def strip_marks(d: Dialect, x: str) -> str:
    return d.sub(x, DIACRITICS, "")


# --- the whole order, once for columns and for single texts ------------------------------------------

_SPACE, _LETTER, _WORD, _MARK = "[ \t\n\x0b\f\r]", "[ء-ی]", "[0-9A-Za-z_\u0600-\u06ff]", "[،؛؟!.:]"
# What takes a joiner instead of a space: verb prefixes, and endings of a noun or an adjective by their stem.
JOINED_PREFIXES = ("می", "نمی")
JOINED_ENDINGS = {"ها": ("", "ی", "یی", "یم", "یت", "یش"), "تر": ("", "ی", "ین")}


def _choice(words) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


#: Steps before numbers are spelled: characters for characters, then patterns for texts, in syntax that Java and Python share.
LETTERS = (LETTERS_FROM + SIGNS_FROM + "“”" + PERSIAN_DIGITS + ARABIC_DIGITS + DELETED, LETTERS_TO + SIGNS_TO + '""' + ASCII_DIGITS * 2)
BARE = ((f"ا{TANWIN}|{TANWIN}ا", "ان"), (TANWIN, "ن"), (DIACRITICS, ""))
#: Steps after that: an ellipsis is a run of dots, and a run of one mark is one mark.
SIGNS = (PUNCTUATION_FROM + "…\u200d\u200b", PUNCTUATION_TO + ".")
SHAPE = (
    (r"([،؛؟!.])\1+", r"\1"),
    (f"(?<!{_WORD})({_choice(JOINED_PREFIXES)}){_SPACE}+(?={_LETTER})", rf"\1{ZWNJ}"),
    (f"(?<={_LETTER}){_SPACE}+({_choice(stem + end for stem, ends in JOINED_ENDINGS.items() for end in ends)})(?!{_WORD})", rf"{ZWNJ}\1"),
    (f"{_SPACE}*{ZWNJ}{_SPACE}*", ZWNJ),
    (f"[^{KEPT}]", " "),
    ("[ \t]+", " "),
    (f"{_SPACE}*({_MARK})", r"\1"),
    (f"({_MARK})(?={_SPACE[:1]}^{_SPACE[1:]})", r"\1 "),
    (f"^{_SPACE}+|{_SPACE}+$", ""),
)
# Characters that composition leaves alone, whatever stands next to them.
_COMPOSED = "^[\u0000-\u02ff\u060c-\u060f\u061b-\u064a\u0660-\u066f\u0671-\u06d5\u06ee-\u06ff\u2002-\u206f]*$"


def composed(x: Column) -> Column:
    """Unicode composition (NFC); texts it cannot change do not reach the Python function."""

    def compose(s: pd.Series) -> pd.Series:
        return s.str.normalize("NFC")

    plain = x.rlike(_COMPOSED)
    return F.when(plain, x).otherwise(F.pandas_udf(compose, "string")(F.when(~plain, x)))


def normalised(x: Column, spelled: bool = True) -> Column:
    """The whole order over a column; null counts as empty."""
    from .numbers import expand_numbers

    x = composed(F.coalesce(x, F.lit("")))
    for signs, steps in ((LETTERS, BARE), (SIGNS, SHAPE)):
        x = F.translate(x, *signs)
        for pattern, new in steps:
            x = F.regexp_replace(x, pattern, new.replace("\\", "$"))
        if spelled and signs is LETTERS:
            x = expand_numbers(x)
    return x


def normalised_text(text: str, spelled: bool = True) -> str:
    """``normalised`` for a single text, outside Spark."""
    from .numbers import expand_text

    text = unicodedata.normalize("NFC", text)
    for (old, new), steps in ((LETTERS, BARE), (SIGNS, SHAPE)):
        text = text.translate({ord(c): new[k] if k < len(new) else None for k, c in enumerate(old)})
        for pattern, put in steps:
            text = re.sub(pattern, put, text)
        if spelled and old is LETTERS[0]:
            text = expand_text(text)
    return text


def fold_marks(x: str) -> str:
    """Spark only: the Arabic decimal sign between digits to a dot, grouping marks of proper groups removed."""
    x = f"regexp_replace({x}, '(?<=[0-9])٫(?=[0-9])', '.')"
    # A mark goes if at most three digits and whole groups of three lead to it, and whole groups from it to the number's end.
    return f"regexp_replace({x}, '(?<=(?<![0-9])[0-9]{{1,3}}(?:[,٬][0-9]{{3}}){{0,9}})[,٬](?=[0-9]{{3}}(?:[,٬][0-9]{{3}})*(?![0-9]))', '')"


def tokens(d: Dialect, x: str) -> str:
    return d.extract_all(x, f"[ء-ی{ZWNJ}]+|[،؛؟!.:()«»\"…]")


def break_symbol(d: Dialect, x: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BREAKS.items())
    return f"(CASE {x} {cases} END)"


def key(d: Dialect, x: str) -> str:
    """Dictionary key: letters folded; marks, stretches and joiners dropped."""
    return d.sub(unify(d, x), f"[ً-ٰٕـ{ZWNJ}]", "")


def timeout_minutes(d: Dialect, x: str) -> str:
    """``30m``, ``2h``, ``90s``, ``1d`` or a bare number of minutes."""
    number = f"CAST({d.extract(x, '^([0-9.]+)', 1)} AS DOUBLE)"
    return f"({number} * CASE right({x}, 1) WHEN 's' THEN CAST(1 AS DOUBLE) / 60 WHEN 'h' THEN 60 WHEN 'd' THEN 1440 ELSE 1 END)"
