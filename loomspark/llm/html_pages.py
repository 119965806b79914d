"""Labelled pages on which the extraction model is trained: many layouts, invented words.

A page is a list of fragments; those of the article carry the label 1. The generator is seeded, so
the model is the same everywhere.
"""

from __future__ import annotations

import random

# Names under which sites keep what is not the article; a generated page draws from them.
OTHER = {
    "menu": "menu navbar nav navigation main-menu site-nav topnav breadcrumb breadcrumbs pagination tabs toc skip-link",
    "header": "header site-header masthead top-bar topbar branding logo page-header banner",
    "footer": "footer site-footer page-footer copyright colophon bottom legal footer-links",
    "sidebar": "sidebar side aside widget widgets related related-posts recommended trending popular tags tag-cloud archive rail",
    "notice": "cookie cookie-banner cookie-notice consent gdpr notice alert modal popup overlay paywall disclaimer announcement",
    "advert": "ad ads advert advertisement sponsored promo promotion banner-ad ad-slot adsbox sponsor dfp outbrain taboola",
    "form": "form subscribe newsletter signup sign-up search search-form login contact-form subscription",
    "comment": "comment comments comment-list disqus replies reply respond discussion reader-comments comment-body",
    "share": "share sharing social social-links follow author-bio byline meta post-meta",
}
ARTICLE = "article content post entry post-content entry-content article-body article-content story story-body main-content page-content body-text text post-body prose single"
PLAIN = "container wrapper row col inner outer grid box section wrap layout page block group"
_PHRASES = {
    "notice": ("We use cookies to improve this site.", "This site uses cookies. Accept all", "By continuing you agree to our policy.", "Accept", "Subscribe to continue reading."),
    "footer": ("© 2024 {w}.com", "All rights reserved.", "Copyright {w}", "Privacy policy", "Terms of use", "© {w}.example.com · {s}"),
    "advert": ("Advertisement", "Sponsored", "Buy now!", "{s}", "Ad: {s}"),
    "form": ("Your e-mail", "Subscribe", "Search", "Name", "Send", "Sign up for our newsletter"),
    "comment": ("Reply", "{w} says:", "{s}", "Great post! {s}", "{p}", "Posted by {w} at 10:31"),
    "sidebar": ("Related", "Most read", "{s}", "{w} {w}", "Tags", "{p}"),
    "share": ("Share", "Tweet", "By {w} {w}", "Posted on May 3, 2021", "Follow us"),
    "header": ("{w}", "{w} {w}", "{s}", "Home"),
    "menu": ("{w}", "{w} {w}", "Home", "About"),
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.syllables = ["".join(self.r.choice(x) for x in ("bcdfglmnprstvz", "aeiouéäö", ["", "n", "r", "s", "tion", "ch"])) for _ in range(60)]

    def word(self) -> str:
        return "".join(self.r.choice(self.syllables) for _ in range(self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self) -> str:
        words = [self.word() for _ in range(self.r.randint(2, 18))]
        return " ".join(words).capitalize() + self.r.choice(".....!?")

    def paragraph(self) -> str:
        return " ".join(self.sentence() for _ in range(self.r.choice((1, 1, 2, 3, 5, 8))))

    def phrase(self, kind: str) -> str:
        text = self.r.choice(_PHRASES[kind])
        return text.replace("{p}", self.paragraph()).replace("{s}", self.sentence()).replace("{w}", self.word())

    def attributes(self, names: str, p: float = 0.9) -> str:
        if self.r.random() > p:
            return ""
        name = self.r.choice(names.split())
        return self.r.choice((f' class="{name}"', f' id="{name}"', f' class="{self.r.choice(PLAIN.split())} {name}"'))

    def text(self, block: str) -> str:
        """Inline markup now and then, some of it never closed."""
        words = block.split(" ")
        if len(words) > 4 and self.r.random() < 0.25:
            at = self.r.randrange(len(words) - 2)
            words[at] = self.r.choice(("<b>", "<em>", "<a href='/x'>", "<span>")) + words[at]
            if self.r.random() < 0.7:
                words[at + 1] += {"<b>": "</b>", "<em": "</em>", "<a ": "</a>", "<sp": "</span>"}[words[at][:3]]
        return " ".join(words)


def labelled_page(seed: int) -> tuple[str, list[tuple[str, int]]]:
    """html, and its text fragments in page order with their labels (fragments are whole blocks)."""
    w = _Writer(seed)
    r, out, gold = w.r, [], []

    def put(tag: str, text: str, label: int, attributes: str = "") -> None:
        gold.append((text, label))
        out.append(f"<{tag}{attributes}>{w.text(text) if label else text}" + (f"</{tag}>" if tag not in ("p", "li") or r.random() < 0.85 else ""))

    def other(kind: str, inside: bool = False) -> None:
        tag = {"menu": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "sidebar": ("aside", "div", "section"), "form": ("form", "form", "div")}.get(kind, ("div", "section", "div"))
        tag = r.choice(tag)
        bare = tag in ("nav", "header", "footer", "aside", "form") and not inside
        out.append(f"<{tag}{w.attributes(OTHER[kind], 0.5 if bare else 1.0)}>")
        if kind == "menu" or (kind in ("sidebar", "footer") and r.random() < 0.5):
            out.append("<ul>" if tag != "ul" else "")
            for _ in range(r.randint(2, 8)):
                text = w.phrase(kind)
                gold.append((text, 0))
                out.append(f'<li><a href="/{w.word()}">{text}</a></li>')
            out.append("</ul>" if tag != "ul" else "")
        elif kind in ("comment", "sidebar") and r.random() < 0.7:
            for _ in range(r.randint(1, 4)):
                put("p" if r.random() < 0.7 else "h3", w.phrase(kind), 0)
        elif r.random() < 0.5:
            text = w.phrase(kind)
            gold.append((text, 0))
            out.append(text)
        else:
            for _ in range(r.randint(1, 3)):
                put(r.choice({"form": ("label", "p", "button"), "header": ("h1", "p", "div", "span")}.get(kind, ("p", "div", "span"))), w.phrase(kind), 0)
        out.append(f"</{tag}>")

    if r.random() < 0.09:  # a fragment: blocks of text and nothing around them
        for _ in range(r.choice((1, 1, 2, 3))):
            if r.random() < 0.3:
                text = w.paragraph()
                gold.append((text, 1))
                out.append(r.choice(("{}", "{}", "<div>{}</div>", "<body>{}</body>")).format(text))
            else:
                put(r.choice(("p", "p", "h1")), w.paragraph(), 1)
        return "".join(out), gold

    out.append(f"<!DOCTYPE html><html><head><title>{w.sentence()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>")
    for kind in ("notice", "header", "menu", "advert", "share"):
        if r.random() < (0.8 if kind in ("menu", "header") else 0.35):
            other(kind)
    wrap = r.choice(("article", "article", "main", "div", "section", "div", "both", "bare"))
    opened = {"both": ["main", "article"], "bare": []}.get(wrap, [wrap])
    for tag in opened:
        out.append(f"<{tag}{w.attributes(ARTICLE, 1.0 if tag in ('div', 'section') else 0.4)}>")
    if r.random() < 0.3:
        out.append(f"<div{w.attributes(PLAIN)}>")
        opened.append("div")
    if r.random() < 0.85:
        inner = opened and r.random() < 0.2
        out.append("<header>" if inner else "")
        put("h1", w.sentence() if r.random() < 0.5 else w.paragraph()[:60], 1)
        out.append("</header>" if inner else "")
    for _ in range(r.choice((1, 2, 3, 5, 8, 14))):
        kind = r.random()
        if kind < 0.72:
            put("p", w.paragraph(), 1)
        elif kind < 0.80:
            put(r.choice(("h2", "h3")), " ".join(w.word() for _ in range(r.randint(1, 6))), 1)
        elif kind < 0.85:
            out.append("<ul>")
            for _ in range(r.randint(2, 4)):
                put("li", w.sentence(), 1)
            out.append("</ul>")
        elif kind < 0.88:
            put(r.choice(("blockquote", "pre")), w.paragraph(), 1)
        elif opened:
            other(r.choice(("advert", "notice", "share", "form", "sidebar")), True)
    if opened and r.random() < 0.15:
        other("comment", True)
    out += [f"</{t}>" for t in reversed(opened)]
    for kind in ("share", "comment", "sidebar", "advert", "form", "notice", "footer"):
        if r.random() < (0.85 if kind == "footer" else 0.4):
            other(kind)
    out.append("</body></html>")
    return "".join(out), gold
