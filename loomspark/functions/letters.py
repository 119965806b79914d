"""Letters to phonemes: a finite-state transducer over marked letters, then syllables by one substitution.

A regular expression names each letter by its kind, where the kind holds all that depends on the
letters around it (first, last, before a long vowel). What depends on the sound before is the state,
so reading a word is a walk through ``ARCS``. Inside, every phoneme is one character; ``spelled``
gives it back its digraph.
"""

from __future__ import annotations

import re

from . import phonemes

# Letter folding, vowel marks, consonant letters, and the vowel put where none is written.
FOLDED = {"ي": "ی", "ى": "ی", "ے": "ی", "ك": "ک", "ہ": "ه", "ة": "ه", "أ": "ء", "إ": "ء", "ؤ": "ء", "ئ": "ء", "ٱ": "ا", "ٲ": "ا", "ٳ": "ا", "ٵ": "ا"}
MARKS = {"َ": "a", "ِ": "e", "ُ": "o", "ٰ": "A"}
NUNATION, DOUBLING = "ًٌٍ", "ّ"
DROPPED = "ْـٕٔ‌"
CONSONANTS = {
    "ب": "b", "پ": "p", "ت": "t", "ط": "t", "ث": "s", "س": "s", "ص": "s", "ج": "j", "چ": "ch", "ح": "h", "ه": "h", "خ": "x", "د": "d", "ذ": "z", "ز": "z", "ض": "z", "ظ": "z",
    "ر": "r", "ژ": "zh", "ش": "sh", "ع": "'", "ء": "'", "غ": "q", "ق": "q", "ف": "f", "ک": "k", "گ": "g", "ل": "l", "م": "m", "ن": "n",
}
EPENTHETIC = "a"

_KEY = str.maketrans({**FOLDED, **dict.fromkeys(DROPPED, None)})
_ONE = {"sh": "S", "zh": "Z", "ch": "C"}
_DIGRAPHS = str.maketrans({one: two for two, one in _ONE.items()})
_VOWELS = "".join(phonemes.VOWELS)
_LONG = "اآ"

#: Kinds of letters, the first that fits.
_KIND = re.compile(
    rf"""
      (?P<small_alef>ٰ) | (?P<mark>[{"".join(MARKS)}]) | (?P<nunation>[{NUNATION}]) | (?P<doubling>{DOUBLING}) | (?P<madda>آ)
    | (?P<first_i>^ای(?![{_LONG}وی])) | (?P<first_u>^او) | (?P<first_alef>^ا) | (?P<alef>ا)
    | (?P<lone_vav>^و$) | (?P<first_vav>^و) | (?P<vav_long>و(?=[{_LONG}])) | (?P<vav_ye>و(?=ی)) | (?P<vav>و)
    | (?P<ye_glide>^ی|ی(?=[{_LONG}و])) | (?P<ye>ی)
    | (?P<last_he>ه$) | (?P<xe>خ) | (?P<consonant>[{"".join(CONSONANTS)}]) | (?P<other>.)
    """,
    re.X | re.S,
)
# States: what was said last. "^" nothing yet, "V" a vowel, "L" the vowel of a written alef, "C" a consonant, "X" that of the letter xe.
_ANY = "^VLCX"
#: kind, states it is read in, what it says (a backslash: by table), state after (a dot: as it was).
ARCS = (
    ("small_alef", _ANY, "\\", "L"), ("mark", _ANY, "\\", "V"), ("nunation", "L", "<an", "C"), ("nunation", "^VCX", "an", "C"), ("doubling", "CX", "+", "C"), ("doubling", "^VL", "", "."),
    ("madda", _ANY, "A", "L"), ("first_i", _ANY, "i", "V"), ("first_u", _ANY, "u", "V"), ("first_alef", _ANY, EPENTHETIC, "V"), ("alef", _ANY, "A", "L"),
    ("lone_vav", _ANY, "o", "V"), ("first_vav", _ANY, "v", "C"),
    ("vav_long", "X", "", "X"), ("vav_long", "^VLC", "v", "C"), ("vav_ye", "X", "", "X"), ("vav_ye", "VL", "v", "C"), ("vav_ye", "^C", "u", "V"),
    ("vav", "X", "o", "V"), ("vav", "VL", "v", "C"), ("vav", "^C", "u", "V"),
    ("ye_glide", _ANY, "y", "C"), ("ye", "VL", "y", "C"), ("ye", "^CX", "i", "V"),
    ("last_he", "CX", "e", "V"), ("last_he", "^VL", "h", "C"), ("xe", _ANY, "\\", "X"), ("consonant", _ANY, "\\", "C"), ("other", "X", "", "C"), ("other", "^VLC", "", "."),
)
_ARCS = {(kind, state): (says, after) for kind, states, says, after in ARCS for state in states}
_SAYS = {**MARKS, **{letter: _ONE.get(sound, sound) for letter, sound in CONSONANTS.items()}}


def key_of(word: str) -> str:
    """The dictionary key of a word: letters folded, joiners and stretches dropped."""
    return word.translate(_KEY)


def written(key: str) -> str:
    """One character for each phoneme that a folded word writes."""
    said, state = "", "^"
    for found in _KIND.finditer(key):
        says, after = _ARCS[found.lastgroup, state]
        if says == "\\":
            said += _SAYS[found[0]]
        elif says == "+":
            said += said[-1]
        elif says.startswith("<"):  # the alef that carries a mark is not said
            said = said[:-1] + says[1:]
        else:
            said += says
        state = state if after == "." else after
    return said


def spelled(said: str) -> str:
    return said.translate(_DIGRAPHS)


def _falls(two: str) -> bool:
    first, second = (phonemes.SONORITY.get(spelled(c), 2) for c in two)
    return first > second


def syllables(run: str, opens: bool, leads: bool) -> str:
    """A run of consonants with vowels in it, so that no syllable starts with two and any end in falling sonority.

    ``opens``: the run starts the word; ``leads``: a vowel follows it. All consonants before the last
    two of a syllable's end take a vowel, and so does the first of those two where sonority does not fall.
    """
    head = run[0] + (EPENTHETIC if len(run) > 1 or not leads else "") if opens else ""
    rest = run[1:] if opens else run
    end = rest[:-1] if leads else rest
    voiced = max(0, len(end) - 2)
    if len(end) > 1 and not _falls(end[-2:]):
        voiced += 1
    return head + "".join(c + EPENTHETIC for c in rest[:voiced]) + rest[voiced:]


_RUN = re.compile(f"[^{_VOWELS}]+")


def by_rule(word: str) -> str:
    """Phonemes of a word from its letters alone."""
    said = written(key_of(word))
    return spelled(_RUN.sub(lambda m: syllables(m[0], m.start() == 0, m.end() < len(said)), said))
