"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks: runs of text under one block-level element. Each block has
features of its ancestors (tags, words of class, id and role) and of its text (length, links,
punctuation, phrases); the chain adds a weight for each pair of neighbouring labels. Weights are
trained by maximum likelihood (forward-backward and Adam) on generated labelled pages of many
layouts, once on the driver; pages are decoded by Viterbi in the tasks.

Edge cases: null, empty and markup-free pages give the text their blocks hold (none: empty);
unclosed and misnested tags, stray brackets and unended comments are read as browsers do, near
enough; pages of any length and depth are read whole, in time that follows their length; repeated
rows give equal rows; other columns of the input are carried through, but for one named like the
text. Embedded documents, drawings, templates and form controls are skipped with what they hold;
formulas and the text of objects belong to the block around them.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_pages import labelled_page

TRAINING_PAGES = 1000
ROUNDS = 200

# A tag, a comment or a declaration. Quantifiers are possessive, and any tag matches that some bracket ends,
# so up to the last bracket a page is scanned in one pass; beyond it only comments count.
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
_UNENDED = re.compile(r"<!--|<!\[CDATA\[")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_RAW = frozenset("script style noscript template textarea iframe svg title select".split())
_BLOCK = frozenset(
    "html head body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd nav article section header footer aside main table thead tbody tfoot tr td th caption "
    "blockquote pre form fieldset figure figcaption address details summary button label legend hr dialog center".split()
)
_VOID = frozenset("br hr img input meta link area base col embed source track wbr param".split())
#: Opening one of these ends an open element of the same family, up to the given border.
_ENDS = {"li": ("li", ("ul", "ol")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
_PHRASE = re.compile(r"©|copyright|all rights|cookie|subscribe|newsletter|advert|sponsored|sign up|log ?in|privacy|terms of|read more|related|share|reply|says:|comment|follow us|posted (?:by|on)", re.I)


@dataclass(frozen=True)
class Block:
    text: str
    features: tuple[str, ...]


def _own(tag: str, attributes: str) -> tuple[str, ...]:
    out = [f"in:{tag}"]
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        out += [f"named:{x}" for x in set(_NAME.findall((a or b or c).lower()))]
    return tuple(out)


_own = lru_cache(maxsize=20_000)(_own)


def _bin(x: float, edges: tuple[float, ...]) -> int:
    return sum(x > e for e in edges)


class _Open:
    """The open elements of a page: what a block needs of them costs no more the deeper it stands."""

    def __init__(self, known=None):
        self.known = known
        self.stack: list[tuple[str, tuple[str, ...], tuple[str, ...]]] = []  # tag, its features, those of the innermost marked element
        self.places: dict[str, list[int]] = {}
        self.active: dict[str, int] = {}

    def push(self, tag: str, attributes: str) -> None:
        own = _own(tag, attributes)
        inner = tuple(f"inner:{f}" for f in own) if len(own) > 1 or own[0] in _MARKED else self.inner
        if self.known is not None:  # features without a weight say nothing, and there is no bound to their number
            own = tuple(f for f in own if f in self.known or f in _MARKED)
            inner = tuple(f for f in inner if f in self.known)
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, own, inner))
        for f in own:
            self.active[f] = self.active.get(f, 0) + 1

    def pop(self) -> None:
        tag, own, _ = self.stack.pop()
        self.places[tag].pop()
        for f in own:
            if self.active[f] == 1:
                del self.active[f]
            else:
                self.active[f] -= 1

    def close(self, names, borders=()) -> None:
        """End the innermost element of these names, and all within it, unless a border stands between."""
        last = lambda tags: max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)
        at = last(names)
        if at >= 0 and at > last(borders):
            while len(self.stack) > at:
                self.pop()

    @property
    def tag(self) -> str:
        return self.stack[-1][0] if self.stack else "none"

    @property
    def inner(self) -> tuple[str, ...]:
        return self.stack[-1][2] if self.stack else ("inner:none",)


def blocks(page: str | None, known=None) -> list[Block]:
    """Leaf blocks of a page in its order, with their features; of ancestors only those ``known``, if given."""
    page = page or ""
    open_ = _Open(known)
    out: list[Block] = []
    parts: list[str] = []
    linked = anchors = 0
    at, length, last = 0, len(page), page.rfind(">")
    unended: set[str] = set()  # skipped elements whose end the rest of the page lacks

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                path = set(open_.active)
                # The innermost ancestor that is named or marks a region says more than those around it.
                path.update(open_.inner)
                n, share = len(text), linked / len(text)
                marks = sum(text.count(c) for c in ".!?")
                path.update((f"parent:{open_.tag}", f"length:{_bin(n, (15, 40, 80, 160, 400))}", f"links:{_bin(share, (0.01, 0.3, 0.7))}", f"marks:{min(marks, 3)}"))
                path.add("bare" if not path & _MARKED else "marked")
                path.update(f"says:{x}" for x in {m.lower() for m in _PHRASE.findall(text)})
                out.append(Block(text, tuple(path)))
            linked = 0

    while at < length:
        m = _MARKUP.search(page, at) if at <= last else _UNENDED.search(page, at)
        end = m.start() if m else length
        if end > at:
            parts.append(page[at:end])
            if anchors:
                linked += end - at
        if not m or at > last:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                anchors = max(0, anchors - 1)
            elif tag in _BLOCK:
                flush()
                open_.close((tag,))
            continue
        if tag in _RAW:
            tail = None
            if tag not in unended and not m[3].endswith("/"):
                tail = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if not tail:
                    unended.add(tag)
            if tail:
                at = tail.end()
            elif tag in ("script", "style"):
                break
        elif tag == "a":
            anchors = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in _BLOCK:
            flush()
            if tag in _ENDS:
                same, borders = _ENDS[tag]
                open_.close(same.split(), borders)
            elif open_.tag == "p":
                open_.pop()
            if tag not in _VOID:
                open_.push(tag, m[3])
    flush()
    return out


#: Ancestors that mark a region of the page.
_MARKED = frozenset(f"in:{t}" for t in "article main nav header footer aside form".split())


@dataclass(frozen=True)
class Chain:
    """Weights of label 1 over label 0 for each feature, and of start, end and neighbouring labels."""

    weights: dict[str, float]
    edges: np.ndarray  # 2 x 2
    ends: np.ndarray  # start of 0 and 1, end of 0 and 1

    def decode(self, page: list[Block]) -> list[int]:
        """The most probable labels, by Viterbi."""
        if not page:
            return []
        get, (e, (s0, s1, f0, f1)) = self.weights.get, (self.edges.tolist(), self.ends.tolist())
        score = [sum([get(f, 0.0) for f in b.features]) for b in page]
        a, b, back = s0, s1 + score[0], []
        for x in score[1:]:
            to0, to1 = b + e[1][0] > a + e[0][0], b + e[1][1] > a + e[0][1]
            back.append((to0, to1))
            a, b = (b + e[1][0] if to0 else a + e[0][0]), (b + e[1][1] if to1 else a + e[0][1]) + x
        label = int(b + f1 > a + f0)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def train_chain(pages: list[tuple[list[Block], list[int]]], rounds: int = ROUNDS, ridge: float = 0.2) -> Chain:
    """Maximum likelihood with a ridge; forward and backward run over all pages at once."""
    pages = [p for p in pages if p[0]]
    names = sorted({f for page, _ in pages for b in page for f in b.features})
    number = {f: i for i, f in enumerate(names)}
    rows, longest = len(pages), max(len(p) for p, _ in pages)
    real = np.zeros((rows, longest), dtype=bool)
    gold = np.zeros((rows, longest), dtype=int)
    cell, feature = [], []
    for i, (page, labels) in enumerate(pages):
        real[i, : len(page)] = True
        gold[i, : len(page)] = labels
        for j, b in enumerate(page):
            cell += [i * longest + j] * len(b.features)
            feature += [number[f] for f in b.features]
    cell, feature = np.array(cell), np.array(feature)
    last = real.sum(axis=1) - 1
    each = np.arange(rows)
    inner = real[:, 1:]
    target_edges = np.array([[(inner & (gold[:, :-1] == a) & (gold[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], dtype=float)
    target_ends = np.array([(gold[:, 0] == 0).sum(), (gold[:, 0] == 1).sum(), (gold[each, last] == 0).sum(), (gold[each, last] == 1).sum()], dtype=float)
    target = np.bincount(feature, weights=gold.ravel()[cell], minlength=len(names))
    theta = np.zeros(len(names) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, edges, ends = theta[: len(names)], theta[len(names) : -4].reshape(2, 2), theta[-4:]
        score = np.zeros((rows, longest, 2))
        score[:, :, 1] = np.bincount(cell, weights=w[feature], minlength=rows * longest).reshape(rows, longest)
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = score[:, 0] + ends[:2]
        for t in range(1, longest):
            ahead[:, t] = np.where(real[:, t, None], np.logaddexp(ahead[:, t - 1, :1] + edges[0], ahead[:, t - 1, 1:] + edges[1]) + score[:, t], ahead[:, t - 1])
        behind[:, -1] = ends[2:]
        for t in range(longest - 2, -1, -1):
            x = behind[:, t + 1] + score[:, t + 1]
            behind[:, t] = np.where(real[:, t + 1, None], np.logaddexp(edges[:, 0] + x[:, :1], edges[:, 1] + x[:, 1:]), ends[2:])
        log_z = np.logaddexp(*(ahead[each, last] + ends[2:]).T)
        node = np.where(real[:, :, None], np.exp(ahead + behind - log_z[:, None, None]), 0)
        pair = ahead[:, :-1, :, None] + edges + (score + behind)[:, 1:, None, :] - log_z[:, None, None, None]
        expected_edges = np.where(inner[:, :, None, None], np.exp(pair), 0).sum(axis=(0, 1))
        expected_ends = np.concatenate([node[:, 0].sum(axis=0), node[each, last].sum(axis=0)])
        expected = np.bincount(feature, weights=node[:, :, 1].ravel()[cell], minlength=len(names))
        slope = np.concatenate([target - expected, (target_edges - expected_edges).ravel(), target_ends - expected_ends]) - ridge * theta
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Chain(dict(zip(names, theta[: len(names)].tolist())), theta[len(names) : -4].reshape(2, 2), theta[-4:])


def label_blocks(page: list[Block], gold: list[tuple[str, int]]) -> list[int]:
    """Labels of blocks by the fragments they hold: 1 if more of the block's text is article than not."""
    labels, k = [], 0
    clean = [(_SPACE.sub(" ", t).strip(), y) for t, y in gold if t.strip()]
    for b in page:
        own, left = [0, 0], len(b.text)
        while k < len(clean) and left > 0:
            own[clean[k][1]] += len(clean[k][0])
            left -= len(clean[k][0])
            k += 1
        labels.append(int(own[1] > own[0]))
    return labels


@lru_cache(maxsize=2)
def default_model(pages: int = TRAINING_PAGES) -> Chain:
    made = [labelled_page(seed) for seed in range(pages)]
    cut = [(blocks(page), gold) for page, gold in made]
    return train_chain([(b, label_blocks(b, gold)) for b, gold in cut])


def main_text(page: str | None, model: Chain) -> str:
    cut = blocks(page, model.weights)
    return "\n\n".join([b.text for b, y in zip(cut, model.decode(cut)) if y])


def extract(pages: DataFrame, html: str = "html", model: Chain | None = None, text: str = "text") -> DataFrame:
    """``pages`` without its html column, and the main text of each."""
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())
    columns = [c for c in pages.columns if c not in (html, text)]
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            found = [main_text(x.as_py(), sent.value) for x in batch.column(html)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.string())], [*columns, text])

    return pages.select(*columns, html).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{text}` string"]))


def op1_html(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
