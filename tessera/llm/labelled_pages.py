"""Labelled pages that the content model is trained on.

A seeded generator builds pages as nested (tag, attributes, children) tuples and
knows which block is main text.  Layouts vary: the place and markup of menus,
adverts, notices, forms, comments and footers, class names or none, an article
element or plain divs, paragraphs, lists, quotes and tables in the text.
"""

from __future__ import annotations

import random

# Class and id names that sites give to the parts of a page.
NAMES = {
    "menu": ["nav", "menu", "navbar", "main-menu", "breadcrumb", "tabs", "toc-links"],
    "header": ["header", "masthead", "site-header", "top-bar", "banner", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal"],
    "sidebar": ["sidebar", "aside", "widget", "rail", "related", "recommended", "popular"],
    "notice": ["cookie-notice", "consent", "alert", "notice", "gdpr", "popup", "modal"],
    "advert": ["ad", "ads", "advert", "sponsor", "promo", "ad-slot", "banner-ad"],
    "form": ["search-form", "newsletter", "signup", "subscribe", "login"],
    "comments": ["comments", "comment-list", "reader-comments", "discussion", "replies", "responses"],
    "share": ["share", "social", "tools", "byline-links"],
    "content": ["content", "article", "post", "entry", "main", "story", "article-body", "post-content"],
}


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.parts = ["ka", "ro", "mi", "ten", "sol", "ver", "an", "du", "pel", "ist", "or", "ga", "lin", "eth", "u"]

    def words(self, low: int, high: int) -> str:
        out = ["".join(self.r.choices(self.parts, k=self.r.randint(1, 3))) for _ in range(self.r.randint(low, high))]
        return " ".join(out)

    def sentence(self, low: int = 5, high: int = 25) -> str:
        text = self.words(low, high)
        marks = self.r.choice([".", ".", ".", "!!", " ###", "&&&", " | |", ""])
        return text[:1].upper() + text[1:] + marks

    def text(self, low: int, high: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(low, high)))

    def named(self, kind: str, chance: float = 0.75) -> dict:
        if self.r.random() > chance:
            return {}
        name = self.r.choice(NAMES[kind])
        return {self.r.choice(["class", "class", "id"]): name}

    def links(self, low: int, high: int) -> list:
        items = [("li", {}, [("a", {"href": "/x"}, [self.words(1, 3)])]) for _ in range(self.r.randint(low, high))]
        return [("ul", {}, items)]

    def boilerplate(self, kind: str) -> tuple:
        tags = {"menu": ["nav", "div", "ul"], "header": ["header", "div"], "footer": ["footer", "footer", "div"], "sidebar": ["aside", "div"], "notice": ["div", "section", "dialog"], "advert": ["div", "aside", "ins"], "form": ["form"], "comments": ["section", "div", "ol"], "share": ["div", "ul"]}
        tag = self.r.choice(tags[kind])
        plain = tag in ("div", "section", "ul", "ol")
        own = self.named(kind, 1.0 if plain else 0.5)
        if kind in ("menu", "share"):
            body = self.links(2, 8)
            body = body[0][2] if tag == "ul" else body
        elif kind == "header":
            body = [("h1" if self.r.random() < 0.3 else "div", {}, [self.words(1, 4)]), *self.links(0, 4)]
        elif kind == "footer":
            body = [self.r.choice(["© ", ""]) + self.sentence(2, 12), *(self.links(1, 4) if self.r.random() < 0.5 else [])]
        elif kind == "sidebar":
            body = [("h3", {}, [self.words(1, 3)]), *self.links(2, 6), *([("p", {}, [self.sentence()])] if self.r.random() < 0.4 else [])]
        elif kind == "notice":
            body = [("p", {}, [self.sentence(4, 16)]), ("button", {}, [self.words(1, 2)])] if self.r.random() < 0.7 else [self.sentence(4, 16)]
        elif kind == "advert":
            body = [self.sentence(2, 14)] if self.r.random() < 0.6 else [("a", {"href": "/y"}, [self.words(2, 6)]), ("p", {}, [self.sentence(2, 12)])]
        elif kind == "form":
            body = [("label", {}, [self.words(1, 4)]), ("input", {"type": "text"}, []), ("button", {}, [self.words(1, 2)])]
        else:
            item = "li" if tag == "ol" else "div"
            body = [("h3", {}, [self.words(1, 2)])] * (tag != "ol") + [(item, self.named("comments", 0.5) if item == "div" else {}, [("b", {}, [self.words(1, 2)]), ("p", {}, [self.text(1, 3)])]) for _ in range(self.r.randint(1, 5))]
        return ("boilerplate", (tag, own, body))

    def article(self) -> tuple:
        body: list = []
        if self.r.random() < 0.85:
            body.append((self.r.choice(["h1", "h1", "h2"]), {}, [self.words(2, 9)]))
        for _ in range(self.r.choice([1, 2, 3, 4, 6, 10, 18])):
            kind = self.r.random()
            if kind < 0.78:
                body.append(("p", {}, [self.text(1, 6)] if self.r.random() < 0.85 else [self.words(1, 4)]))
            elif kind < 0.84:
                body.append(("h2", {}, [self.words(1, 6)]))
            elif kind < 0.9:
                body.append(("ul", {}, [("li", {}, [self.sentence(2, 14)]) for _ in range(self.r.randint(1, 5))]))
            elif kind < 0.95:
                body.append(("blockquote", {}, [("p", {}, [self.text(1, 3)])]))
            else:
                body.append(("pre", {}, [self.text(1, 3)]))
            if self.r.random() < 0.2:
                body[-1][2].append(("a", {"href": "/z"}, [self.words(1, 4)]))
        for kind in ("advert", "share", "sidebar", "form", "notice"):
            if self.r.random() < 0.12:
                body.insert(self.r.randint(0, len(body)), self.boilerplate(kind))
        if self.r.random() < 0.25:  # what readers say stands below the text, often in the same element
            body.append(self.boilerplate("comments"))
        tag = self.r.choice(["article", "article", "article", "main", "div", "section"])
        own = self.named("content", 1.0 if tag in ("div", "section") else 0.2)
        return ("content", (tag, own, body))

    def page(self) -> tuple:
        """The body element; it or its parts are wrapped as ("content" or "boilerplate", element)."""
        before = [self.boilerplate(k) for k in ("header", "menu", "notice", "advert", "form") if self.r.random() < 0.5]
        after = [self.boilerplate(k) for k in ("comments", "sidebar", "advert", "form", "footer", "notice") if self.r.random() < 0.5]
        self.r.shuffle(before)
        middle = [self.article()]
        if self.r.random() < 0.3:
            beside = [self.boilerplate("sidebar"), *middle]
            middle = [("div", {"class": self.r.choice(["row", "container", "wrap", "page"])}, beside if self.r.random() < 0.5 else beside[::-1])]
        if self.r.random() < 0.12:  # no element of its own around the text: it is the body's
            text = self.article()[1][2]
            return ("content", ("body", {}, [*before, *text, *after]))
        return ("body", {}, [*before, *middle, *after])


def pages(count: int, seed: int = 11) -> list[tuple]:
    return [Maker(seed * 100_003 + i).page() for i in range(count)]
