"""Word classes, and which words of a sentence carry the linker.

A sentence becomes a column of windows: each word with its class, its neighbours and theirs. The
decision is a table read from the top, whose rows name a condition on the window and a verdict. Only
one condition looks at what was decided to the left, so the column is folded from left to right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from . import persian
from .lexicon import LIGHT_STEMS, POSSESSIVES, Lexicon
from .letters import key_of

#: Word classes of the linker rules: our own short lists, replaceable as a whole.
CLASSES = {
    "pron": "من تو او ما شما آنها خود", "det": "این آن همین همان هر چند هیچ", "prep": "به از با در بر تا برای بدون", "conj": "و یا که اگر اما", "part": "را هم نیز فقط",
    "adv": "امروز دیروز فردا همیشه خیلی", "num": "یک دو سه چهار پنج شش هفت هشت ده بیست صد هزار", "ord": "اول دوم سوم چهارم", "name": "علی مریم تهران ایران", "adj": "بزرگ خوب زیبا کوچک نو سرد",
    "relational": "روی زیر کنار میان پیش", "title": "آقای خانم دکتر", "copula": "است هست نیست بود شد", "time": "صبح ظهر عصر شب", "head": "ساعت شماره صفحه کلاس", "measure": "کیلو متر لیتر",
    "span": "صبح ظهر عصر شب روز هفته ماه سال ساعت", "question": "چه چرا کجا کی چطور کدام چقدر",
}
#: Classes in order of precedence, with the tag each gives.
TAGS = (
    ("pron", "pron"), ("det", "det"), ("question", "adv"), ("adv", "adv"), ("conj", "conj"), ("part", "part"), ("ord", "ord"), ("num", "num"), ("name", "name"), ("prep", "prep"), ("relational", "prep"), ("adj", "adj"),
)
NOMINAL = frozenset("noun name pron det adj ord num".split())
#: Tags that no linker precedes, and tags that carry none.
NEVER_BEFORE, NEVER_ON = frozenset("verb conj part adv".split()), frozenset("verb prep conj part adv pron det".split())


class Word(NamedTuple):
    key: str
    tag: str


_EDGE = Word("", "punct")


@dataclass(frozen=True)
class Window:
    """A word between its neighbours, as the rules see it."""

    at: int
    word: Word
    before: Word
    next: Word
    after: Word
    written: bool
    linked_before: bool


class Linker:
    """Tags and linker flags of the words of a sentence."""

    def __init__(self, lexicon: Lexicon, classes: dict[str, str] = CLASSES):
        self.lexicon = lexicon
        self.sets = {k: frozenset(map(key_of, v.split())) for k, v in classes.items()}
        union = lambda names: frozenset().union(*(self.sets[k] for k in names.split()))
        self.closed, self.refused = union("pron det prep conj part adv question num measure"), union("prep conj part adv question copula")
        self.always = union("relational title")
        # The first class of a word gives its tag: written last, it stands.
        self.tags = {word: tag for kind, tag in reversed(TAGS) for word in self.sets[kind]}
        self.tags |= dict.fromkeys([*persian.BREAKS, *persian.BREAKS.values(), ""], "punct")
        self.rules = self._rules()

    def tag(self, key: str) -> str:
        """The class of a word: listed, else told by its form."""
        ends_in = lambda endings, kind: any(key.removesuffix(e) in self.sets[kind] for e in endings if key.endswith(e))
        if key.endswith("ً") and self.tags.get(key) not in ("pron", "det"):
            return "adv"
        if listed := self.tags.get(key):
            return listed
        if self.lexicon.is_verb(key):
            return "verb"
        if key in self.lexicon:
            return "noun"
        return "prep" if ends_in(POSSESSIVES, "prep") else "adj" if ends_in("ی", "adj") else "noun"

    def _rules(self) -> tuple[tuple[Callable[[Window], bool], bool | Callable[[Window], bool]], ...]:
        """Conditions and verdicts, the first condition that holds decides; the rows below ``always`` are for other words."""
        sets, lexicon = self.sets, self.lexicon
        nominal = lambda w: w.next.tag in NOMINAL
        indefinite = lambda w: lexicon.is_indefinite(w.next.key)
        light = lambda w: lexicon.is_verb(w.after.key) and any(stem in w.after.key for stem in LIGHT_STEMS)
        # What ends before the copula is the predicate's head, unless something on its left holds it.
        held = lambda w: w.at > 0 and (
            w.before.tag == "prep" or (w.before.tag in ("name", "pron") and not w.linked_before) or (w.word.tag == "adj" and w.linked_before)
        )
        said_of = lambda w: w.after.key in sets["copula"]
        conjoined = (key_of("و"), key_of("از"))
        return (
            (lambda w: "punct" in (w.word.tag, w.next.tag), False),
            (lambda w: w.written, True),
            (lambda w: w.next.key in self.refused or w.next.tag in NEVER_BEFORE, False),
            (lambda w: w.word.key in self.always, nominal),
            (lambda w: w.word.tag == "ord", lambda w: w.at > 0 and nominal(w)),
            (lambda w: w.word.tag == "num", lambda w: w.next.key in sets["time"]),
            (lambda w: w.word.key in self.closed or w.word.tag in NEVER_ON, False),
            (lambda w: lexicon.has_possessive(w.word.key), False),
            (lambda w: w.before.tag == "det", False),
            (lambda w: w.next.tag == "noun" and light(w), False),
            (lambda w: w.next.tag in ("noun", "name") and w.before.tag == "prep" and w.after.tag == "verb" and not said_of(w), False),
            (lambda w: w.next.tag == "noun" and indefinite(w) and w.next.key[:-1] not in sets["adj"], False),
            (lambda w: said_of(w) and not held(w) and not (w.next.tag == "adj" and indefinite(w)), False),
            (lambda w: not said_of(w) and w.next.tag == "adj" and w.after.key in conjoined and not indefinite(w), False),
            (lambda w: w.word.tag == "name", False),
            (lambda w: w.next.tag == "num", lambda w: w.word.key in sets["head"]),
            (lambda w: w.word.key in sets["span"] and w.next.tag == "noun" and w.next.key not in sets["span"], False),
            (lambda w: w.word.tag == "adj", lambda w: w.next.tag in ("noun", "name", "pron", "det")),
            (lambda w: True, nominal),
        )

    def flags(self, tokens: list[str], hints: list[str] | None = None) -> list[bool]:
        """Whether each token carries the linker; ``hints`` replace the tags if there are as many."""
        parted = [self.lexicon.without_linker(t) for t in tokens]
        keys = [key_of(t) for t, _ in parted]
        tags = hints if hints and len(hints) == len(tokens) else map(self.tag, keys)
        line = [_EDGE, *map(Word, keys, tags), _EDGE, _EDGE]
        out: list[bool] = []
        for at, (_, written) in enumerate(parted):
            window = Window(at, line[at + 1], line[at], line[at + 2], line[at + 3], written, bool(out and out[-1]))
            verdict = next(then for holds, then in self.rules if holds(window))
            out.append(verdict if isinstance(verdict, bool) else verdict(window))
        return out
