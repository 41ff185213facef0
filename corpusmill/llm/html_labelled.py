"""Labelled pages to train the extractor on: page layouts made here, with the label of every block.

Texts are random syllables, in several alphabets, so that no word but those of the layouts is learned.  A part of the pages
(``nameless``) says nothing by elements or names: all parts are ``div`` with names of random letters, so that the place of a
block and its text have to tell.
"""

from __future__ import annotations

import html
import random

#: Names that sites give to the parts of a page.
CONTENT = ["content", "main-content", "post-content", "entry-content", "article-body", "story", "post", "text", "article", "body-copy"]
ASIDE = ["sidebar", "side-bar", "widget", "related", "related-posts", "recommended", "toc-box", "tags", "share", "social", "newsletter", "popular"]
ADVERT = ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "ad-slot"]
NOTICE = ["cookie", "cookie-notice", "consent", "gdpr", "notice", "alert", "popup", "modal", "disclaimer", "privacy-notice"]
COMMENT = ["comments", "comment", "comment-list", "commentlist", "reader-comments", "discussion", "replies", "responses", "disqus"]
MENU = ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "top-menu"]
HEAD = ["header", "masthead", "site-header", "topbar", "page-header", "logo"]
FOOT = ["footer", "site-footer", "copyright", "legal", "bottom", "foot"]
SYLLABLES = ["an", "the", "er", "ing", "tion", "re", "ou", "que", "ver", "sch", "ó", "ña", "è", "ß", "ai", "con", "la", "st", "nd", "пр", "ова", "の", "は"]


class Maker:
    """Builds one page at a time; ``labels`` gets 1 for a block of the main text, 0 for another."""

    def __init__(self, seed: int, nameless: float = 0.3):
        self.r = random.Random(seed)
        self.share, self.nameless = nameless, False
        self.labels: list[int] = []

    def words(self, n: int) -> str:
        r = self.r
        out = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]
        out[0] = out[0].capitalize()
        if r.random() < 0.1:
            out = [w + r.choice(["", "***", "%%%", "###", "&&", "!!"]) for w in out]
        return html.escape(" ".join(out), quote=False)

    def sentence(self, n: int) -> str:
        return self.words(n) + self.r.choice([".", ".", ".", "!", "?", ":", ""])

    def block(self, tag: str, inner: str, label: int, attributes: str = "") -> str:
        self.labels.append(label)
        close = "" if tag in ("p", "li") and self.r.random() < 0.2 else f"</{tag}>"
        return f"<{tag}{attributes}>{inner}{close}"

    def named(self, tag: str, names: list[str]) -> tuple[str, str]:
        """An opening and closing tag that says what it is by its element, class, id or role."""
        key = self.r.choice(["class", "class", "id"])
        name = self.r.choice(names)
        if self.nameless:
            return f'<div {key}="{"".join(self.r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(self.r.randint(4, 9)))}">', "</div>"
        if self.r.random() < 0.3:
            name += " " + self.r.choice(["box", "wide", "left", "c2", "wrap"])
        return f'<{tag} {key}="{name}">', f"</{tag}>"

    def element(self, tag: str) -> tuple[str, str]:
        """An opening and closing tag of an element that says by itself what it is."""
        return self.named(tag, [tag]) if self.nameless else (f"<{tag}>", f"</{tag}>")

    def bare(self, inner: str) -> str:
        """Text of a part of the page that isn't main text: within an element of its own, or directly in the part's."""
        if self.r.random() < 0.5:
            self.labels.append(0)
            return inner
        return self.block(self.r.choice(["p", "div"]), inner, 0)

    def links(self, n: int, prose: float = 0.0) -> str:
        items = "".join(self.block("li", f'<a href="/x">{self.words(self.r.randint(1, 4))}</a>' + (" " + self.words(3) if self.r.random() < prose else ""), 0) for _ in range(n))
        return f"<ul>{items}</ul>"

    def paragraph(self, label: int) -> str:
        n = self.r.choice([1, 2, 3, 8, 20, 40, 80, 120])
        inner = " ".join(self.sentence(max(1, n // 3)) for _ in range(3 if n > 6 else 1))
        if self.r.random() < 0.2:
            inner = f"<b>{self.words(5)}</b> {inner}" if self.r.random() < 0.5 else f"<b>{self.words(4)}.<br>"
        if self.r.random() < 0.15:
            inner += f' <a href="/y">{self.words(2)}</a>.'
        return inner if label < 0 else self.block("p", inner, label)

    def main(self) -> str:
        r = self.r
        if not self.nameless and r.random() < 0.2:  # little text: the names alone have to tell
            parts = [self.block("h1", self.words(r.randint(1, 3)), 1)] if r.random() < 0.4 else []
            return "".join(parts) + "".join(self.block("p", self.sentence(r.randint(1, 4)), 1) for _ in range(r.randint(1, 2)))
        parts = [self.block("h1", self.words(r.randint(1, 9)), 1)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, 14)):
            kind = r.random()
            if kind < 0.72:
                parts.append(self.paragraph(1))
            elif kind < 0.8:
                parts.append(self.block(r.choice(["h2", "h3"]), self.words(r.randint(1, 6)), 1))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(self.block("li", self.sentence(r.randint(2, 15)), 1) for _ in range(r.randint(2, 4))) + "</ul>")
            elif kind < 0.9:
                parts.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.words(r.randint(1, 3)), 1) for _ in range(2)) + "</tr>" for _ in range(2)) + "</table>")
            elif kind < 0.93:
                parts.append("<blockquote>" + self.paragraph(1) + "</blockquote>")
            elif kind < 0.95:
                parts.append(self.block("pre", self.words(6), 1))
            else:
                parts.append(self.boilerplate(r.choice(["advert", "aside", "notice", "form"])))
        if r.random() < 0.25:  # the text below its heading, or a later part of it, in an element of its own
            at = r.choice([1, 1, r.randint(0, len(parts))])
            b, z = r.choice([("<div>", "</div>"), ("<section>", "</section>"), self.named("div", CONTENT)])
            parts = [*parts[:at], b, *parts[at:], z]
        return "".join(parts)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        if kind == "menu":
            a, z = self.element("nav") if r.random() < 0.6 or self.nameless else self.named(r.choice(["div", "ul"]), MENU) if r.random() < 0.9 else ('<div role="navigation">', "</div>")
            return a + (self.bare(self.words(r.randint(1, 6))) if r.random() < 0.15 else self.links(r.randint(2, 7))) + z
        if kind == "header":
            a, z = self.element("header") if r.random() < 0.5 else self.named("div", HEAD)
            return a + self.bare(self.words(r.randint(1, 5))) + (self.links(3) if r.random() < 0.5 else "") + z
        if kind == "footer":
            a, z = self.element("footer") if r.random() < 0.7 else self.named("div", FOOT)
            sign = r.choice(["&copy; ", "", "© 2020 ", "Copyright "])
            inner = sign + self.words(r.randint(1, 12)) + r.choice(["", " &middot; " + self.sentence(r.randint(2, 14))])
            return a + self.bare(inner) + (self.links(3) if r.random() < 0.3 else "") + z
        if kind == "advert":
            a, z = self.named(r.choice(["div", "div", "aside", "section"]), ADVERT)
            return a + self.bare(self.sentence(r.randint(1, 25))) + z
        if kind == "aside":
            a, z = self.element("aside") if r.random() < 0.4 else self.named(r.choice(["div", "aside", "section"]), ASIDE)
            parts = [self.block(r.choice(["h2", "h3", "h4"]), self.words(r.randint(1, 4)), 0)]
            parts.append(self.links(r.randint(2, 6), 0.3) if r.random() < 0.6 else self.block("p", self.sentence(r.randint(3, 40)), 0))
            return a + "".join(parts) + z
        if kind == "notice":
            a, z = self.named("div", NOTICE)
            return a + self.bare(self.sentence(r.randint(4, 30))) + (self.block("div", "<button>OK</button>", 0) if r.random() < 0.4 else "") + z
        if kind == "form":
            if r.random() < 0.4:
                return "<form>" + self.bare(f"<label>{self.words(r.randint(1, 4))}</label><input> <button>{self.words(1)}</button>") + "</form>"
            rows = "".join(self.block("div", f"<label>{self.words(2)}</label> <input type=text>", 0) for _ in range(r.randint(1, 3)))
            return "<form action='/s'>" + rows + self.block("p", f"<button>{self.words(1)}</button>", 0) + "</form>"
        a, z = self.named(r.choice(["div", "section", "ol"]), COMMENT)
        parts = [self.block("h3", self.words(r.randint(1, 3)), 0)] if r.random() < 0.7 else []
        for _ in range(r.randint(1, 5)):
            b, y = ("<div>", "</div>") if self.nameless else r.choice([("<article>", "</article>"), ("<li>", "</li>"), ('<div class="comment">', "</div>"), ("<div>", "</div>")])
            parts.append(b + self.block("p", self.sentence(r.randint(3, 60)), 0) + y)
        return a + "".join(parts) + z

    def page(self) -> tuple[str, list[int]]:
        """A page and the labels of its blocks in order."""
        r = self.r
        self.labels = []
        self.nameless = r.random() < self.share
        before = [k for k in ("header", "menu", "notice", "advert", "menu") if r.random() < 0.45]
        after = [k for k in ("aside", "comments", "advert", "form", "menu", "notice", "footer") if r.random() < 0.45]
        parts = [self.boilerplate(k) for k in before]
        shape = r.random()
        if self.nameless:
            a, z = self.named("div", CONTENT)
        elif shape < 0.45:
            a, z = "<article>", "</article>"
        elif shape < 0.6:
            a, z = "<main>", "</main>"
        elif shape < 0.65:
            a, z = "<main><article>", "</article></main>"
        elif shape < 0.93:
            a, z = self.named(r.choice(["div", "section"]), CONTENT)
        elif shape < 0.97:
            a, z = "<div>", "</div>"
        else:
            a, z = "", ""
        parts.append(a + self.main())
        if r.random() < 0.15:
            parts.append(self.boilerplate("comments"))
        parts.append(z)
        parts += [self.boilerplate(k) for k in after]
        if r.random() < 0.03:  # no layout at all
            self.labels = []
            return (self.paragraph(1) if r.random() < 0.5 else self.block("p", self.sentence(5), 1)[3:]), self.labels
        title = self.words(4)
        body = "".join(f"<!-- {self.words(1)} -->" + p if r.random() < 0.1 else p for p in parts)
        if r.random() < 0.2:  # a fragment
            return body, self.labels
        return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{body}</body></html>', self.labels


def labelled_pages(n: int, seed: int = 5) -> list[tuple[str, list[int]]]:
    """``n`` pages with their labels; the same for the same arguments."""
    maker = Maker(seed)
    return [maker.page() for _ in range(n)]
