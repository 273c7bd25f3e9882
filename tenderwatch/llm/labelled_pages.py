"""Labelled pages that the extraction model is trained on.

Every page is put together from sections whose kind is known, in layouts, names and lengths drawn
from a fixed seed. Section elements and names follow common usage, some pages use no telling names
at all, and words are syllables, so a model learns from structure and shape, not from vocabulary.
"""

from __future__ import annotations

import random
from collections.abc import Callable

# Elements and names that sections of each kind commonly carry.
NAMES = {
    "nav": "nav menu navbar navigation topbar breadcrumb breadcrumbs links pagination toc".split(),
    "header": "header masthead top branding site-header logo".split(),
    "footer": "footer foot site-footer copyright legal colophon bottom".split(),
    "sidebar": "sidebar side widget related recommended popular share social tags more".split(),
    "notice": "notice cookie consent alert banner gdpr popup modal newsletter subscribe warning message".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion adbox".split(),
    "form": "form search login signup contact".split(),
    "comments": "comments comment comment-list replies reply discussion respond responses".split(),
    "main": "content article post entry story main text page-content post-body article-body".split(),
}
TAGS = {
    "nav": ["nav", "nav", "div", "ul"],
    "header": ["header", "header", "div"],
    "footer": ["footer", "footer", "div"],
    "sidebar": ["aside", "aside", "div"],
    "notice": ["div", "section", "p"],
    "ad": ["div", "div", "aside", "section"],
    "form": ["form"],
    "comments": ["section", "div", "ol"],
    "main": ["article", "article", "main", "div", "section"],
}
_SYLLABLES = "an be con der el fa gu hi in jo ka le mo na or pa qui ra so ta un ver wi xe yo zu é ü ñ".split()

#: a page and its blocks in order, each with 1 if it belongs to the main text
Labelled = tuple[str, list[tuple[str, int]]]


class _Maker:
    def __init__(self, seed: int):
        self.random = random.Random(seed)
        self.parts: list[str] = []
        self.labels: list[tuple[str, int]] = []

    def words(self, low: int, high: int) -> str:
        r = self.random
        return " ".join("".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(2, 18).capitalize() + self.random.choice("....?!") for _ in range(self.random.randint(low, high)))

    def body(self) -> str:
        """Running text, or such as ends without a stop, is cut into columns, or shouts."""
        r = self.random
        kind = r.random()
        if kind < 0.6:
            return self.sentences(1, 6)
        if kind < 0.75:
            return self.words(1, 60) + r.choice([",", "", "", "-"])
        if kind < 0.85:
            mark = r.choice([" | ", "|", "### ", "!! ", " · ", "%%% ", " > "])
            return mark.join(self.words(1, 3) for _ in range(r.randint(2, 40)))
        if kind < 0.9:
            return self.sentences(1, 3).upper()
        return self.words(1, 3) + r.choice([".", ":", ",", ""])

    def block(self, tag: str, text: str, label: int, inner: Callable[[str], str] = str) -> None:
        self.labels.append((text, label))
        close = "" if tag == "p" and self.random.random() < 0.1 else f"</{tag}>"
        self.parts.append(f"<{tag}>{inner(text)}{close}")

    def section(self, kind: str, plain: bool, fill: Callable[[], None]) -> None:
        r = self.random
        tag = r.choice(TAGS[kind])
        names = "" if plain or r.random() < (0.25 if tag not in ("div", "section", "p", "ol", "ul") else 0.05) else r.choice(NAMES[kind])
        attribute = r.choice(["class", "id"])
        self.parts.append(f'<{tag} {attribute}="{names}">' if names else f"<{tag}>")
        fill()
        self.parts.append(f"</{tag}>")

    def links(self, low: int, high: int) -> None:
        bare = self.random.random() < 0.2
        if not bare:
            self.parts.append("<ul>")
        for _ in range(self.random.randint(low, high)):
            self.block("li" if not bare else "div", self.words(1, 3), 0, lambda t: f'<a href="/x">{t}</a>')
        if not bare:
            self.parts.append("</ul>")

    def lone(self, text: str) -> None:
        """Text straight in the section, or in a block of its own."""
        tag = self.random.choice(["", "", "p", "div"])
        if tag:
            self.block(tag, text, 0)
        else:
            self.labels.append((text, 0))
            self.parts.append(f"<div>{text}</div>")

    def main(self) -> None:
        r = self.random
        if r.random() < 0.85:
            title = self.words(1, 12).capitalize() if r.random() < 0.7 else self.body()[:60].strip()
            self.block(r.choice(["h1", "h1", "h2"]), title or "a", 1)
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.75:
                self.block("p", self.body(), 1, lambda t: t if r.random() < 0.7 else f"<b>{t}</b>")
            elif kind < 0.83:
                self.block(r.choice(["h2", "h3"]), self.words(1, 6).capitalize(), 1)
            elif kind < 0.9:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), self.sentences(1, 3), 1)
            else:
                self.parts.append("<ul>")
                for _ in range(r.randint(2, 6)):
                    self.block("li", self.words(2, 12), 1)
                self.parts.append("</ul>")

    def comments(self) -> None:
        r = self.random
        if r.random() < 0.7:
            self.block(r.choice(["h2", "h3"]), self.words(1, 2).capitalize(), 0)
        for _ in range(r.randint(1, 6)):
            name = r.choice(["comment", "reply", "comment-body", ""])
            self.parts.append(f'<div class="{name}">' if name else "<div>")
            for _ in range(r.randint(1, 2)):
                self.block("p", self.sentences(1, 3), 0)
            self.parts.append("</div>")

    def form(self) -> None:
        for _ in range(self.random.randint(1, 3)):
            self.block("div", self.words(1, 4), 0, lambda t: f"<label>{t}</label><input name=q>")

    def footer(self) -> None:
        start = self.random.choice(["© ", "", "", "© 2020 "])
        self.lone(start + self.words(2, 14) + self.random.choice([".", ""]))

    def short(self) -> None:
        for _ in range(self.random.randint(1, 2)):
            self.lone(self.sentences(1, 3) if self.random.random() < 0.7 else self.words(1, 6))

    def page(self) -> Labelled:
        r = self.random
        plain = r.random() < 0.1
        extra = {"ad": self.short, "notice": self.short, "sidebar": lambda: (self.links(2, 5) if r.random() < 0.6 else self.short()), "form": self.form}
        self.parts.append("<html><head><title>t</title></head><body>")
        before = [("header", lambda: self.lone(self.words(1, 5))), ("nav", lambda: self.links(3, 8))]
        for kind, fill in before:
            if r.random() < 0.8:
                self.section(kind, plain, fill)
        for kind in r.sample(sorted(extra), r.randint(0, 2)):
            self.section(kind, plain and kind == "sidebar", extra[kind])
        inner = r.random() < 0.25
        self.section("main", plain, lambda: (self.main(), inner and self.section("ad", False, self.short), inner and self.main()))
        if r.random() < 0.45:
            self.section("comments", False, self.comments)
        for kind in r.sample(sorted(extra), r.randint(0, 2)):
            self.section(kind, plain and kind == "sidebar", extra[kind])
        if r.random() < 0.9:
            self.section("footer", plain, self.footer)
        self.parts.append("</body></html>" if r.random() < 0.9 else "")
        return "".join(self.parts), self.labels


def labelled_pages(n: int, seed: int = 7) -> list[Labelled]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(n)]
