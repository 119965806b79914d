"""Words and their phonemes: readings, verb forms, affixes and stress.

The lexicon is data (key, readings in order of frequency); a small one of our own stands here as the
default, and ``Lexicon.build`` takes any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

from . import persian, phonemes
from .letters import by_rule, key_of

_VOWELS = "".join(phonemes.VOWELS)
_FIRST, _LAST = re.compile(f"^[{_VOWELS}]"), re.compile(f"[{_VOWELS}]$")


class Affix(NamedTuple):
    """A spelling taken off one end of a word, its sound after a consonant and after a vowel, and where stress falls.

    Stress: ``affix`` on the affix itself, ``base`` as in the base, ``last`` on the last vowel.
    """

    end: str
    spelling: str
    hard: str
    soft: str
    stress: str


# Affixes in order of trial, verb endings, possessive endings, words without stress, stems of compound verbs.
AFFIXES = tuple(
    [Affix("start", spelling, sound, sound, "affix") for spelling, sound in (("نمی", "nemi"), ("می", "mi"), ("ن", "na"), ("ب", "be"))]
    + [Affix("stop", *row) for row in (
        ("شان", "eshAn", "shAn", "base"), ("تان", "etAn", "tAn", "base"), ("مان", "emAn", "mAn", "base"), ("ترین", "tarin", "tarin", "last"), ("های", "hAy", "hAy", "last"), ("یان", "yAn", "yAn", "last"),
        ("ها", "hA", "hA", "last"), ("ان", "An", "An", "last"), ("تر", "tar", "tar", "last"), ("یم", "im", "yam", "base"), ("ید", "id", "yid", "base"), ("ند", "and", "yand", "base"),
        ("ام", "am", "'am", "base"), ("م", "am", "yam", "base"), ("ت", "at", "yat", "base"), ("ش", "ash", "yash", "base"), ("ی", "i", "yi", "base"),
    )]
)
PRESENT = (("م", "am"), ("ی", "i"), ("د", "ad"), ("یم", "im"), ("ید", "id"), ("ند", "and"))
PAST = (("م", "am"), ("ی", "i"), ("", ""), ("یم", "im"), ("ید", "id"), ("ند", "and"))
POSSESSIVES = ("شان", "تان", "مان", "یم", "م", "ت", "ش")
UNSTRESSED = frozenset("را به از در با بر تا که و هر".split())
LIGHT_STEMS = ("کرد", "کن", "شد", "شو", "داد", "ده", "زد", "زن", "گرفت", "گیر", "خورد", "خور", "کشید", "کش", "آورد", "آور", "یافت", "یاب", "نمود", "نما")
DEPTH = 4

#: Our own verbs (past stem, its phonemes, present stem, its phonemes) and words.
VERBS = (
    ("رفت", "raft", "رو", "rav"), ("خورد", "xord", "خور", "xor"), ("گفت", "goft", "گو", "gu"), ("کرد", "kard", "کن", "kon"), ("آمد", "Amad", "آ", "A"), ("خواند", "xAnd", "خوان", "xAn"),
    ("دید", "did", "بین", "bin"), ("داد", "dAd", "ده", "dah"), ("شد", "shod", "شو", "shav"), ("نوشت", "nevesht", "نویس", "nevis"), ("خرید", "xarid", "خر", "xar"), ("شنید", "shenid", "شنو", "shenav"),
)
WORDS = {
    "کتاب": ["ketAb"], "خانه": ["xAne"], "من": ["man"], "ما": ["mA"], "تو": ["to"], "او": ["u"], "شما": ["shomA"], "این": ["in"], "آن": ["An"], "بزرگ": ["bozorg"], "کوچک": ["kuchak"], "خوب": ["xub"],
    "روز": ["ruz"], "شب": ["shab"], "صبح": ["sobh"], "سلام": ["salAm"], "دنیا": ["donyA"], "شهر": ["shahr"], "پدر": ["pedar"], "مادر": ["mAdar"], "نامه": ["nAme"], "هوا": ["havA"], "سرد": ["sard"],
    "مرد": ["mard", "mord"], "نه": ["na", "noh"], "پر": ["por", "par"], "کرم": ["kerm", "karam", "kerem"], "مهر": ["mehr", "mohr"], "تنگ": ["tang", "tong"], "کشت": ["kesht", "kosht"], "گل": ["gol"],
    "در": ["dar"], "از": ["az"], "به": ["be"], "با": ["bA"], "را": ["rA"], "و": ["o"], "که": ["ke"], "است": ["ast"], "بود": ["bud"], "صدا": ["sedA"], "میز": ["miz"], "روی": ["ruy"], "زیر": ["zir"],
    "مدرسه": ["madrese"], "علی": ["'ali"], "مریم": ["maryam"], "تهران": ["tehrAn"], "دوست": ["dust"], "ساعت": ["sA'at"], "سیب": ["sib"], "آب": ["Ab"], "باغ": ["bAq"], "دیروز": ["diruz"], "زیبا": ["zibA"],
}


def vowels_of(sound: str) -> int:
    return sum(map(sound.count, phonemes.VOWELS))


def _met(left: str, right: str) -> bool:
    """Whether two vowels would meet where these sounds are joined."""
    return bool(_LAST.search(left) and _FIRST.search(right))


class Form(NamedTuple):
    spelling: str
    sound: str
    stress: int


def _ended(stems, endings, stress: int) -> list[Form]:
    """Stems with endings; where two vowels meet a glide is spoken and written."""
    return [Form(o + "ی" * _met(s, e) + end, s + "y" * _met(s, e) + e, stress) for o, s in stems for end, e in endings]


def _begun(prefix: str, spelling: str, sound: str) -> list[tuple[str, str]]:
    """Spellings of a stem under a verb prefix; before a vowel the short ones take a glide, written or not."""
    said = next(a.hard for a in AFFIXES if a.end == "start" and a.spelling == prefix)
    if len(prefix) > 1 or not _FIRST.search(sound):
        return [(prefix + spelling, said + sound)]
    glided = {"be": "biy", "na": "nay"}[said] + sound
    return [(prefix + "ی" + re.sub("^آ", "ا", spelling), glided), (prefix + spelling, glided)]


def conjugate(past: str, past_sound: str, present: str, present_sound: str) -> list[Form]:
    """(form, phonemes, stressed vowel) of a verb; for one spelling the earlier form is the commoner."""
    then, now, none = (past, past_sound), (present, present_sound), (("", ""),)
    last = vowels_of(past_sound) - 1
    # What is put together, in order: prefixes ("" for the bare stem), stem, endings, stressed vowel.
    plan = (
        (("",), then, PAST, last), (("می", "نمی"), now, PRESENT, 0), (("",), now, none + PRESENT, vowels_of(present_sound) - 1), (("ن", "ب"), now, PRESENT, 0),
        (("می", "نمی", "ن"), then, PAST, 0), (("ب", "ن"), now, none, 0), (("",), then, (("ه", "e"),), last), (("",), then, (("ن", "an"),), last + 1),
    )
    return [form for prefixes, stem, endings, stress in plan for p in prefixes for form in _ended(_begun(p, *stem) if p else [stem], endings, stress)]


@dataclass
class Lexicon:
    """Readings by key, in order; verb forms and stems; the stressed vowel where it is not the last."""

    readings: dict[str, list[str]] = field(default_factory=dict)
    verbs: set[str] = field(default_factory=set)
    stems: set[str] = field(default_factory=set)
    stress: dict[str, int] = field(default_factory=dict)
    curated: set[str] = field(default_factory=set)

    @classmethod
    def build(cls, words: dict[str, Iterable[str]] = WORDS, verbs=VERBS) -> Lexicon:
        """Curated words come first and keep their stress; verb readings follow."""
        out = cls()
        for word, found in words.items():
            out.add(word, found)
        out.curated = set(out.readings)
        for verb in verbs:
            out.stems.update(map(key_of, (verb[0], verb[2])))
            for form in conjugate(*verb):
                key = out.add(form.spelling, [form.sound])
                out.verbs.add(key)
                if key not in out.curated:
                    out.stress.setdefault(key, form.stress)
        return out

    def add(self, word: str, found: Iterable[str]) -> str:
        key = key_of(word)
        self.readings[key] = list(dict.fromkeys([*self.readings.get(key, ()), *found]))
        return key

    def __contains__(self, word: str) -> bool:
        return key_of(word) in self.readings

    def is_verb(self, key: str) -> bool:
        return key in self.verbs and key not in self.curated

    def _peeled(self, key: str, left: int):
        """Analyses of a key by one affix, in order of trial."""
        for affix in AFFIXES if left else ():
            at_start = affix.end == "start"
            base = key.removeprefix(affix.spelling) if at_start else key.removesuffix(affix.spelling)
            if base in ("", key) or (at_start and base not in self.verbs and base not in self.stems):
                continue
            found = self.analyse(base, left - 1)
            if not found or not found[0]:
                continue
            sound, stress = found
            if at_start:
                yield affix.hard + sound, 0
            else:
                own = {"last": None, "base": vowels_of(sound) - 1 if stress is None else stress}[affix.stress]
                yield sound + (affix.soft if _LAST.search(sound) else affix.hard), own

    def analyse(self, word: str, left: int = DEPTH) -> tuple[str, int | None] | None:
        """Phonemes and stressed vowel (None: the last) by lookup, else by what an affix leaves."""
        key = key_of(word)
        if found := self.readings.get(key):
            return found[0], self.stress.get(key)
        return next(self._peeled(key, left), None)

    def phonemes(self, word: str) -> str:
        found = self.analyse(word)
        return found[0] if found else by_rule(word)

    def stressed(self, sound: str, word: str, force: bool | None = None, vowel: int | None = None) -> str:
        """The sound with a stress mark before a vowel: the given one, else the word's; function words have none unless forced."""
        count = vowels_of(sound)
        if vowel is None:
            if not (force if force is not None else key_of(word) not in UNSTRESSED):
                return sound
            known = self.analyse(word)
            vowel = count - 1 if known is None or known[1] is None else known[1]
        if not count:
            return sound
        before = max(0, min(vowel, count - 1))
        return re.sub(f"^((?:[^{_VOWELS}]*[{_VOWELS}]){{{before}}}[^{_VOWELS}]*)", r"\g<1>1", sound)

    def without_linker(self, token: str) -> tuple[str, bool]:
        """A token without a written linker, and whether one was there: a hamza, joiner and ye, or ye after a known word in alef or vav."""
        plain = token.replace("ٔ", "") if "ٔ" in token else token.removesuffix(f"{persian.ZWNJ}ی")
        if plain != token:
            return plain, True
        known = token in self or self.is_verb(key_of(token))
        found = None if known else re.fullmatch(f"(.*[او]){persian.ZWNJ}?ی", token)
        return (found[1], True) if found and len(token) > 2 and found[1] in self else (token, False)

    def stem(self, word: str) -> str:
        """Without a written linker: joiner and ye always, alef and ye where the rest is known."""
        if word.endswith(f"{persian.ZWNJ}ی"):
            return word[:-2]
        return word[:-1] if re.search(".ای$", word) and word[:-1] in self else word

    def has_possessive(self, key: str) -> bool:
        """A known word with a possessive ending of its own."""
        if key in self.readings or self.is_verb(key):
            return False
        bases = {key.removesuffix(e) for e in POSSESSIVES if len(key) > len(e) + 1} - {key}
        return not self.readings.keys().isdisjoint(bases | {b.removesuffix("ی") for b in bases})

    def is_indefinite(self, key: str) -> bool:
        """A known word with the indefinite ye."""
        return key.endswith("ی") and key[:-1] in self.readings and key not in self.readings and not self.is_verb(key)


@lru_cache(maxsize=1)
def default_lexicon() -> Lexicon:
    return Lexicon.build()
