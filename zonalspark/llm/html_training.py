"""Labelled pages that the classifier of HTML extraction learns from, made from a seed: there are no labelled real ones.

A page is a layout of containers, some of them content and the rest boilerplate, each under a semantic element, under a
div with telling class names, or under a bare div. Utility classes, wrappers and states (`has-sidebar`) are put on both
alike, so that only what tells is learned. All texts are invented words.
"""

from __future__ import annotations

import html
import random

SYLLABLES = "ka lo mi ren tos vu del par sin gor be nal tri mo sa fen qui lar dun es".split()
#: Names of containers in pages of today, by what they hold; "" stands for a div without a name.
CONTENT = "article article-body articleBody content main-content post post-content postBody entry entry-content story story-body main page-content text body-text article__text blog-post single-post news-article prose rich-text".split()
BOILERPLATE = {
    "nav": "nav navbar menu main-menu navigation topnav breadcrumb breadcrumbs nav-links pagination pager toc-nav skip-links site-menu offcanvas-menu".split(),
    "header": "header site-header masthead top-bar toolbar branding banner page-header-bar".split(),
    "footer": "footer site-footer colophon copyright bottom-bar footer-links legal contentinfo".split(),
    "aside": "sidebar aside widget widgets rail right-column left-sidebar widget-area complementary secondary".split(),
    "notice": "cookie cookie-banner cookies consent gdpr notice notices alert popup modal overlay dialog paywall message-bar disclaimer".split(),
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion outbrain taboola banner-ad ad-slot".split(),
    "form": "form newsletter subscribe subscription signup login signin search search-form contact-form".split(),
    "comment": "comments comment comment-list replies reply respond disqus discussion reader-comments responses feedback".split(),
    "related": "related related-posts recommended recommendations more-stories teaser teasers read-next popular trending latest share sharing social social-links tags tag-list byline-links".split(),
}
UTILITY = "overflow-hidden clearfix row col-8 container wrapper inner outer flex mt-4 block hidden-xs relative w-full section grid layout box group js-ready lazy-loaded animated page-wrap site".split()
STATES = "has-sidebar with-sidebar no-sidebar has-menu is-open no-ads with-comments has-footer not-login is-social with-ads no-cookie".split()
ON_ARTICLE = "social share featured sidebar hidden gems widget menu promo comment first last sticky format-standard type-post status-publish".split()
SEMANTIC = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "notice": "dialog"}
#: Pages that the classifier learns from, at most and by default.
PAGES, SEED = 500, 17


class Maker:
    """Pages of one seed; every fifth name is kept for tests unless `every` name may be used."""

    def __init__(self, seed: int, every: bool = False):
        self.r, self.every = random.Random(seed), every

    def names(self, names: list[str]) -> list[str]:
        return names if self.every else [n for i, n in enumerate(names) if i % 5 != 3]

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 3)))

    def words(self, low: int, high: int) -> str:
        out = " ".join(self.word() for _ in range(self.r.randint(low, high)))
        return out[0].upper() + out[1:]

    def sentences(self, low: int, high: int) -> str:
        return " ".join(self.words(5, 18) + self.r.choice("...?!。") for _ in range(self.r.randint(low, high)))

    def attributes(self, tag: str, name: str) -> str:
        own = [name] if name else []
        if tag in ("html", "body", "article", "main"):
            own += self.r.sample(ON_ARTICLE + STATES, self.r.randint(0, 2))
        own += self.r.sample(UTILITY, self.r.choice((0, 0, 1, 2)))
        own += self.r.sample(STATES, self.r.random() < 0.15)
        self.r.shuffle(own)
        if not own:
            return ""
        if len(own) == 1 and self.r.random() < 0.2:
            return f' id="{own[0]}"'
        return f' class="{" ".join(own)}"'

    def inline(self, text: str) -> str:
        words = [html.escape(w) for w in text.split(" ")]
        for mark in ("b", "em", 'a href="/x"', "span"):
            if self.r.random() < 0.15:
                i = self.r.randrange(len(words))
                words[i] = f"<{mark}>{words[i]}</{mark.split()[0]}>"
        return " ".join(words)

    def content(self, found: set[str]) -> str:
        """Blocks of an article; their texts go into found."""
        out = []

        def put(tag: str, text: str) -> None:
            found.add(" ".join(text.split()))
            out.append(f"<{tag}>{self.inline(text)}</{tag}>" if tag else f"{self.inline(text)}<br><br>")

        kind = self.r.random()
        tag = "p" if kind < 0.8 else "div"
        if self.r.random() < 0.8:
            clean = self.words(3, 9)
            found.add(clean)
            heading = f"<h1>{clean}</h1>"
            out.append(f"<header>{heading}</header>" if self.r.random() < 0.25 else heading)
        for _ in range(self.r.randint(1, 9)):
            what = self.r.random()
            if what < 0.5:
                put(tag, self.sentences(1, 5))
            elif what < 0.62:
                put(tag, self.words(5, 60))
            elif what < 0.7:
                put(tag, self.words(1, 3) + ".")
            elif what < 0.78:
                put("h2", self.words(2, 6))
            elif what < 0.88:
                out.append("<ul>")
                for _ in range(self.r.randint(1, 5)):
                    put("li", self.sentences(1, 1) if self.r.random() < 0.6 else self.words(2, 7))
                out.append("</ul>")
            elif what < 0.93:
                put("blockquote", self.sentences(1, 2))
            elif what < 0.96:
                out.append("<table><tr>")
                for _ in range(self.r.randint(2, 5)):
                    put("td", self.words(1, 4))
                out.append("</tr></table>")
            elif self.r.random() < 0.7:
                out.append(self.boilerplate(self.r.choice(("advert", "related", "form", "aside"))))
        if self.r.random() < 0.12:
            out.append("<footer>" + self.links(1, 4) + "</footer>")
        return "".join(out)

    def links(self, low: int, high: int) -> str:
        every = [f'<a href="/{self.word()}">{self.words(1, 5)}</a>' for _ in range(self.r.randint(low, high))]
        shape = self.r.random()
        if shape < 0.6:
            return "<ul>" + "".join(f"<li>{a}</li>" for a in every) + "</ul>"
        return " | ".join(every) if shape < 0.8 else "".join(f"<div>{a}</div>" for a in every)

    def plain(self, low: int, high: int) -> str:
        """Text that reads like an article's."""
        shape = self.r.random()
        if shape < 0.3:
            return self.sentences(low, high)
        return "".join(f"<p>{self.sentences(1, 4)}</p>" if self.r.random() < 0.6 else f"<div>{self.words(2, 12)}</div>" for _ in range(self.r.randint(low, high)))

    def boilerplate(self, kind: str) -> str:
        named = self.r.random()
        tag = SEMANTIC.get(kind, "section" if self.r.random() < 0.2 else "div") if named < 0.65 else "div"
        name = self.r.choice(self.names(BOILERPLATE[kind])) if named > 0.3 or tag in ("div", "section") else ""
        r = self.r.random()
        if kind in ("nav", "related"):
            inside = self.links(2, 9) if r < 0.6 else self.links(1, 3) + f"<p>{self.sentences(1, 3)}</p>" if r < 0.8 else self.plain(1, 4)
        elif kind == "header":
            inside = (f"<p>{self.words(1, 4)}</p>" if r < 0.6 else self.plain(1, 3)) + (self.links(2, 6) if self.r.random() < 0.6 else "")
        elif kind == "footer":
            text = self.sentences(1, 4) if self.r.random() < 0.6 else self.words(1, 4)
            mark = self.r.choice(("&copy; 20", "&copy; ", "", ""))
            inside = (self.links(1, 8) if r < 0.4 else "") + self.r.choice((f"<p>{mark}{text}</p>", f"{mark}{text}", f"<div>{mark}{text}</div>"))
        elif kind == "form":
            inside = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (self.plain(1, 3) if r < 0.5 else "")
        elif kind == "comment":
            inside = f"<h3>{self.words(1, 3)}</h3>" + "".join(f'<{t}{self.attributes("div", "")}><p>{self.words(1, 2)}: {self.sentences(1, 3)}</p></{t}>' for t in (self.r.choice(("div", "li", "article")),) for _ in range(self.r.randint(1, 5)))
        else:
            inside = self.plain(1, 5) + (self.links(1, 4) if r < 0.4 else "")
        if tag == "dialog":
            return f"<dialog open{self.attributes(tag, name)}>{inside}</dialog>"
        return f"<{tag}{self.attributes(tag, name)}>{inside}</{tag}>"

    def page(self) -> tuple[str, set[str]]:
        """A page, and the texts of its content blocks."""
        r, found = self.r, set()
        where = r.random()
        tag = "article" if where < 0.35 else "main" if where < 0.5 else "section" if where < 0.58 else "td" if where < 0.62 else "div"
        name = "" if tag in ("article", "main") and r.random() < 0.5 else r.choice(self.names(CONTENT))
        if tag == "div" and r.random() < 0.12:
            name = ""
        inside = self.content(found)
        if r.random() < 0.3:
            inside = f"<div{self.attributes('div', '')}>{inside}</div>"
        if r.random() < 0.35:
            inside += self.boilerplate(r.choice(("comment", "related")))
        body = f"<{tag}{self.attributes(tag, name)}>{inside}</{tag}>"
        if tag == "td":
            body = f"<table><tr><td>{self.links(2, 8)}</td>{body}</tr></table>"
        elif r.random() < 0.3:
            body = f"<main{self.attributes('main', '')}>{body}</main>" if tag != "main" else f"<div{self.attributes('div', '')}>{body}</div>"
        before = [k for k in ("notice", "header", "nav", "advert", "form") if r.random() < 0.45]
        after = [k for k in ("aside", "comment", "related", "advert", "notice", "form") if r.random() < 0.4]
        body = "".join(map(self.boilerplate, before)) + body + "".join(map(self.boilerplate, after))
        for _ in range(r.choice((0, 1, 1, 2))):
            body = f"<div{self.attributes('div', r.choice(('', '', 'page', 'main', 'content', 'wrap')))}>{body}</div>"
        if r.random() < 0.1:
            body = f"<form id=aspnetForm>{body}</form>"
        if r.random() < 0.8:
            body += self.boilerplate("footer")
        return f"<html><head><title>{self.words(2, 5)}</title></head><body{self.attributes('body', '')}>{body}</body></html>", found


def pages(n: int = PAGES, seed: int = SEED, every: bool = False) -> list[tuple[str, set[str]]]:
    """n pages with the texts of their content; with every, a fifth of the names are ones that training never uses."""
    maker = Maker(seed, every)
    return [maker.page() for _ in range(n)]
