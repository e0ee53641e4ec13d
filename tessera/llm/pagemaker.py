"""Labelled pages to train the extractor on: invented pages of many layouts, of
which it is known which blocks are the article's."""

from __future__ import annotations

import random

_SYLLABLES = "an be co da el fi go ha in ju ka lo me no ou pa re si ta un vi wa é ö ñ".split()
_CONTENT = ["post", "entry", "content", "story", "article", "post-content", "entry-content", "articleBody", "main-content", "text", "body-copy", "article__body"]
_PLAIN = ["wrap", "container", "col", "row", "box", "inner", "grid", "w1", "x7", "block", "module"]
_ADS = ["ad", "ads", "advert", "advertisement", "sponsored", "banner", "promo", "adsbox", "ad-slot", "sponsor"]
_SIDE = ["sidebar", "widget", "related", "recommended", "popular", "trending", "more-stories", "side"]
_NOTICE = ["cookie", "cookie-notice", "notice", "consent", "alert", "gdpr", "banner-cookie", "message", "warning", "popup", "modal", "paywall"]
_COMMENTS = ["comments", "comment", "comment-list", "replies", "responses", "discussion", "reader-comments", "disqus", "comment-body", "reply"]
_MENUS = ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topnav", "links", "pagination", "toolbar"]
_FEET = ["footer", "foot", "copyright", "legal", "site-footer", "colophon", "bottom"]
_HEADS = ["header", "masthead", "site-header", "logo", "branding", "topbar", "tagline"]
_FORMS = ["newsletter", "signup", "subscribe", "login", "search", "contact-form", "search-form"]
_SHARE = ["share", "social", "tags", "meta", "byline", "author-box"]


class _Maker:
    def __init__(self, seed: int):
        self.r, self.out = random.Random(seed), []

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        w = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        w[0] = w[0].capitalize()
        if r.random() < 0.1:
            w = [x + r.choice(["###", "%%%", "***", "&amp;&amp;&amp;", "!!"]) for x in w]
        for i in range(len(w) - 1):
            if r.random() < 0.08:
                w[i] += r.choice([",", ",", ".", ";"])
        return " ".join(w)

    def emit(self, html: str, label: int | None = None) -> None:
        self.out.append((html, label))

    def text(self, tag: str, text: str, label: int, attr: str = "") -> None:
        self.emit(f"<{tag}{attr}>")
        self.emit(text, label)
        self.emit(f"</{tag}>")

    def named(self, names: list[str], p: float = 0.85) -> str:
        r = self.r
        n = r.choice(names) if r.random() < p else r.choice(_PLAIN)
        return r.choice([f' class="{n}"', f' id="{n}"', f' class="{r.choice(_PLAIN)} {n}"', f' class="{n} {r.choice(_PLAIN)}" id="b{r.randint(1, 9)}"'])

    def links(self, names: list[str], tag: str) -> None:
        r = self.r
        self.emit(f"<{tag}{self.named(names, 0.9 if tag == 'div' else 0.3)}>")
        listed = r.random() < 0.7
        self.emit("<ul>" if listed else "")
        for _ in range(r.randint(2, 7)):
            self.emit("<li>" if listed else "<div>")
            self.emit(f'<a href="/{r.randint(1, 99)}">{self.words(1, 4)}</a>', 0)
            self.emit("</li>" if listed else "</div>")
        self.emit("</ul>" if listed else "")
        self.emit(f"</{tag}>")

    def said(self, lo: int, hi: int) -> str:
        return self.words(lo, hi) + self.r.choice([".", ".", ".", "!", "?", ""])

    def aside_text(self, names: list[str], tag: str, lo: int, hi: int, n: int = 1) -> None:
        self.emit(f"<{tag}{self.named(names, 0.95 if tag == 'div' else 0.5) if tag in ('div', 'section') or self.r.random() < 0.6 else ''}>")
        for _ in range(n):
            if self.r.random() < 0.5:
                self.text(self.r.choice(["p", "p", "div", "h3"]), self.said(lo, hi), 0)
            else:
                self.emit(self.said(lo, hi), 0)
                self.emit("<hr>")
        self.emit(f"</{tag}>")

    def form(self) -> None:
        r = self.r
        self.emit(f"<form{self.named(_FORMS, 0.7)}>")
        self.text("label", self.words(1, 5), 0)
        self.emit('<input name="q">')
        if r.random() < 0.5:
            self.text("p", self.said(4, 18), 0)
        self.text("button", self.words(1, 2), 0)
        self.emit("</form>")

    def comments(self) -> None:
        r = self.r
        outer = r.choice(["div", "section", "section", "ol", "aside"])
        self.emit(f"<{outer}{self.named(_COMMENTS, 1)}>")
        if r.random() < 0.6:
            self.text(r.choice(["h2", "h3"]), self.words(1, 4), 0)
        for _ in range(r.randint(1, 5)):
            tag = r.choice(["div", "li", "article"])
            self.emit(f"<{tag}{self.named(_COMMENTS, 0.8)}>")
            self.text(r.choice(["p", "p", "div"]), self.said(3, 60), 0)
            self.emit(f"</{tag}>")
        self.emit(f"</{outer}>")

    def noise(self) -> None:
        """One piece of what surrounds an article, or stands in it."""
        r = self.r
        kind = r.randrange(9)
        if kind == 0:
            self.aside_text(_ADS, r.choice(["div", "div", "section", "aside"]), 3, 30)
        elif kind == 1:
            self.aside_text(_SIDE, r.choice(["aside", "aside", "div"]), 3, 40, r.randint(1, 3))
        elif kind == 2:
            self.links(_SIDE, r.choice(["aside", "div"]))
        elif kind == 3:
            self.aside_text(_NOTICE, r.choice(["div", "div", "section"]), 4, 40)
        elif kind == 4:
            self.form()
        elif kind == 5:
            self.comments()
        elif kind == 6:
            self.links(_MENUS, r.choice(["nav", "div"]))
        elif kind == 7:
            self.aside_text(_SHARE, "div", 1, 8)
        else:
            self.emit(r.choice(["<script>var t = '<p>no</p>';</script>", "<style>p{margin:0}</style>", "<!-- note <p>no</p> -->", "<noscript></noscript>"]))

    def article(self) -> None:
        r = self.r
        tag = r.choice(["article", "article", "main", "div", "div", "section"])
        self.emit(f"<{tag}{self.named(_CONTENT, 0.95) if tag in ('div', 'section') else r.choice(['', '', self.named(_CONTENT, 0.7)])}>")
        inner = r.random() < 0.2
        if inner:
            self.emit("<header>" if r.random() < 0.4 else f"<div{self.named(_CONTENT, 0.4)}>")
        close_inner = "</header>" if inner and self.out[-1][0] == "<header>" else "</div>" if inner else ""
        if r.random() < 0.85:
            self.text(r.choice(["h1", "h1", "h2"]), self.words(2, 12), 1)
        if close_inner == "</header>":
            self.emit(close_inner)
        for _ in range(r.choice([1, 2, 3, 5, 8, 12])):
            p = r.random()
            if p < 0.62:
                body = self.words(1, r.choice([4, 20, 60, 120]))
                body += r.choice([".", ".", ".", "", "?"])
                if r.random() < 0.25:
                    cut = body.split(" ")
                    k = r.randrange(len(cut))
                    cut[k] = r.choice(["<b>%s</b>", "<a href='/x'>%s</a>", "<em>%s</em>", "%s<br>", "<b>%s"]) % cut[k]
                    body = " ".join(cut)
                self.emit("<p>")
                self.emit(body, 1)
                self.emit(r.choice(["</p>", "</p>", "</p>", ""]))
            elif p < 0.7:
                self.text(r.choice(["h2", "h3"]), self.words(1, 8), 1)
            elif p < 0.75:
                self.emit("<ul>")
                for _ in range(r.randint(2, 5)):
                    self.text("li", self.words(2, 20), 1)
                self.emit("</ul>")
            elif p < 0.8:
                self.text(r.choice(["blockquote", "pre"]), self.words(5, 40), 1)
            elif p < 0.83:
                self.emit("<table><tr>")
                for _ in range(3):
                    self.text("td", self.words(1, 5), 1)
                self.emit("</tr></table>")
            else:
                self.noise()
        if close_inner == "</div>":
            self.emit(close_inner)
        if r.random() < 0.15:
            self.comments()
        self.emit(f"</{tag}>")

    def page(self) -> list[tuple[str, int | None]]:
        r = self.r
        self.emit("<!DOCTYPE html><html><head><title>")
        self.emit(self.words(2, 10), 0)
        self.emit("</title></head><body>")
        wrap = r.random() < 0.5
        around = r.choice(["div", "div", "main", "section"])
        self.emit(f"<{around}{self.named(_PLAIN, 1) if around == 'div' else ''}>" if wrap else "")
        if r.random() < 0.6:
            tag = r.choice(["header", "div"])
            self.aside_text(_HEADS, tag, 1, 10)
        if r.random() < 0.8:
            self.links(_MENUS, r.choice(["nav", "nav", "div"]))
        for _ in range(r.choice([0, 1, 1, 2])):
            self.noise()
        self.article()
        for _ in range(r.choice([0, 1, 2, 3])):
            self.noise()
        if r.random() < 0.85:
            tag = r.choice(["footer", "footer", "div"])
            self.emit(f"<{tag}{self.named(_FEET, 0.9 if tag == 'div' else 0.3)}>")
            self.emit(r.choice(["&copy; ", "Copyright ", ""]) + self.words(2, 15), 0)
            self.emit(f"</{tag}>")
        self.emit(f"</{around}>" if wrap else "")
        self.emit(r.choice(["</body></html>", ""]))
        return self.out


def labelled_page(seed: int) -> list[tuple[str, int | None]]:
    """Pieces of a page in order: (html, label); text has a label (1: article)."""
    return _Maker(seed).page()
