"""Labelled web pages for training: random layouts whose main text is known."""

from __future__ import annotations

import random
import re

_SYLLABLES = "an be co da el fo ga hi in jo ka lo me no or pa qu re sa to un ve wi yo ze tion ment ing".split()

# fixed values: words of class and id attributes
MAIN_TOKENS = "content article post main entry story body text page-content post-content".split()
BOILERPLATE = {
    "nav": "nav navbar menu breadcrumb navigation topbar".split(),
    "header": "header masthead site-header logo banner".split(),
    "footer": "footer site-footer copyright bottom colophon".split(),
    "aside": "sidebar aside related widget trending recommended".split(),
    "ad": "ad ads advert advertisement sponsor promo banner-ad".split(),
    "notice": "cookie cookie-notice notice consent gdpr alert popup newsletter".split(),
    "comments": "comments comment respond discussion replies comment-list".split(),
    "form": "form search subscribe login signup contact-form".split(),
    "share": "share social sharing follow".split(),
}
# layout words that say nothing about what an element holds
NEUTRAL = "col row inner wrap box grid left right block clearfix wide".split()


class PageMaker:
    """Made-up pages; every element carries its label in ``data-m``, text beside blocks in a comment before it."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, lo: int, hi: int) -> str:
        r = self.r
        out = ["".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(lo, hi))]
        for i in range(0, len(out), r.randint(6, 14)):
            out[i] = out[i].capitalize()
            if i:
                out[i - 1] += r.choice([".", ".", ",", "?"])
        return " ".join(out) + r.choice(["", "."])

    def el(self, tag: str, inner: str, main: bool, names: list[str] | None = None) -> str:
        attr = ""
        if names and self.r.random() < 0.75:
            attr = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}"'
        elif self.r.random() < 0.2:
            attr = f' class="{self.r.choice(NEUTRAL)}-{self.r.choice(NEUTRAL)}"'
        return f'<{tag}{attr} data-m="{int(main)}">{inner}</{tag}>'

    def links(self, n: int, tag: str = "li") -> str:
        items = "".join(self.el(tag, f'<a href="/{i}">{self.words(1, 4)}</a>', False) for i in range(n))
        return self.el("ul", items, False) if tag == "li" else items

    def loose(self, main: bool) -> str:
        """Text without a block around it."""
        if main:
            text = "<br><br>".join(self.words(8, 90) for _ in range(self.r.choice([1, 1, 2, 4])))
            return "".join(f"<!--m1-->{t}" if i % 2 == 0 else t for i, t in enumerate(re.split("(<br><br>)", text)))
        text = self.words(2, 18)
        if self.r.random() < 0.3:
            text += f' <a href="/b">{self.words(1, 4)}</a>'
        return f"<!--m0-->{text}"

    def paragraph(self, main: bool) -> str:
        text = self.words(4, 90) if self.r.random() < 0.8 else self.words(1, 6)
        if self.r.random() < 0.2:
            text = f"<b>{text}</b>"
        if self.r.random() < 0.15:
            text += f' <a href="/x">{self.words(1, 5)}</a> {self.words(2, 20)}'
        return self.el("p", text, main)

    def boilerplate(self, kind: str) -> str:
        r, names = self.r, BOILERPLATE[kind]
        semantic = r.random() < 0.6
        if kind == "nav":
            return self.el("nav" if semantic else "div", self.links(r.randint(3, 9)), False, names)
        if kind == "header":
            inner = self.el(r.choice(["h1", "h2", "div", "p"]), self.words(1, 5), False)
            return self.el("header" if semantic else "div", inner, False, names)
        if kind == "footer":
            inner = r.choice([f"&copy; {self.words(2, 20)}", self.paragraph(False), self.links(r.randint(2, 6))])
            return self.el("footer" if semantic else "div", inner, False, names)
        if kind == "aside":
            inner = self.el("h3", self.words(1, 4), False) + r.choice([self.links(r.randint(2, 8)), self.paragraph(False)])
            return self.el("aside" if semantic else "div", inner, False, names)
        if kind == "comments":
            items = "".join(
                self.el("li" if r.random() < 0.6 else "div", self.el("p", self.words(3, 50), False), False, ["comment", "reply"])
                for _ in range(r.randint(1, 5))
            )
            return self.el(r.choice(["section", "div", "ol"]), self.el("h3", self.words(1, 3), False) + items, False, names)
        if kind == "form":
            inner = self.el("p", self.words(2, 12), False) + '<input name="q"><input type="submit">'
            return self.el("form" if semantic else "div", f"<label>{self.words(1, 3)}</label>" + inner, False, names)
        text = self.words(3, 25)
        inner = text if r.random() < 0.6 else self.el("p", text, False)
        if kind in ("ad", "share") or r.random() < 0.3:
            inner += f'<a href="/b">{self.words(1, 4)}</a>'
        return self.el(r.choice(["div", "div", "section", "aside"]), inner, False, names)

    def article(self) -> str:
        r = self.r
        parts = [self.el(r.choice(["h1", "h1", "h2"]), self.words(2, 12), True)] if r.random() < 0.9 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            x = r.random()
            if x < 0.08:
                parts.append(self.loose(True))
            elif x < 0.75:
                parts.append(self.paragraph(True))
            elif x < 0.82:
                parts.append(self.el("h2", self.words(1, 8), True))
            elif x < 0.9:
                parts.append(self.el("ul", "".join(self.el("li", self.words(2, 15), True) for _ in range(r.randint(1, 5))), True))
            else:
                parts.append(self.el("blockquote", self.paragraph(True), True))
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), self.boilerplate(r.choice(["ad", "share", "notice", "form", "aside", "comments"])))
        if r.random() < 0.1:
            parts.insert(r.randint(0, len(parts)), self.el("div", self.loose(False) + self.links(2), False, BOILERPLATE["ad"]))
        inner = "".join(parts)
        if r.random() < 0.08:
            # no element of its own
            return inner
        for _ in range(r.randint(0, 2)):
            inner = self.el("div", inner, True, MAIN_TOKENS)
        return self.el(r.choice(["article", "article", "article", "main", "div", "section"]), inner, True, MAIN_TOKENS)

    def page(self) -> str:
        r = self.r
        kinds = list(BOILERPLATE)
        before = [self.boilerplate(k) for k in r.sample(kinds, r.randint(0, 4))]
        after = [self.boilerplate(k) for k in r.sample(kinds, r.randint(0, 4))]
        for side in (before, after):
            if r.random() < 0.3:
                side.insert(r.randint(0, len(side)), self.loose(False))
        body = "".join([*before, self.article(), *after])
        if r.random() < 0.3:
            body = self.el("div", body, True, ["wrapper", "container", "page"])
        late = self.loose(False) if r.random() < 0.1 else ""
        return f'<!DOCTYPE html><html data-m="1"><head><title>{self.words(2, 8)}</title></head><body data-m="1">{body}</body>{late}</html>'
