"""Labelled pages that the HTML extractor is trained on.

Each page is written as (tag, class or id words, kind, children or text): kind 1 marks main text, 0 what surrounds it, and
2 a frame that holds both. Layouts follow common site frames: news, blog, wiki, shop, forum and bare pages. The words are invented.
"""

from __future__ import annotations

import random

WORDS = "tarn velo miru osk plen dova kesh rindu falo beg sutra lomi trave nusk ondar pelu grit haven sol mede quorn".split()


def _text(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) for _ in range(n)).capitalize() + "."


def _links(r, kind_word: str, n: int, tag: str = "ul"):
    item = "li" if tag == "ul" else "span"
    return (tag, kind_word, 0, [(item, "", 0, [("a", "", 0, _text(r, r.randint(1, 3)))]) for _ in range(n)])


#: Boilerplate containers: tag, class words, and what they hold.
FRAMES = [
    ("nav", "", "links"), ("nav", "menu main-nav", "links"), ("div", "menu", "links"), ("div", "nav navigation navbar", "links"), ("div", "breadcrumb breadcrumbs", "links"),
    ("header", "", "mixed"), ("header", "site-header page-header", "mixed"), ("header", "", "site"), ("header", "", "site"), ("div", "", "site"), ("div", "header masthead banner top-bar", "mixed"), ("div", "logo branding", "short"),
    ("footer", "", "mixed"), ("footer", "site-footer", "mixed"), ("div", "footer copyright legal", "short"), ("div", "footer bottom", "mixed"),
    ("aside", "", "mixed"), ("aside", "sidebar", "links"), ("div", "sidebar side widget", "mixed"), ("section", "related related-posts more recommended", "links"), ("div", "related recommended popular trending", "links"),
    ("div", "ad", "short"), ("div", "ads advert advertisement", "short"), ("div", "sponsored promo promotion", "long"), ("section", "ad-slot ad-banner", "short"), ("ins", "adsbygoogle", "short"),
    ("div", "cookie cookie-notice consent", "long"), ("div", "notice cookie-banner gdpr", "short"), ("div", "alert popup modal overlay", "short"), ("div", "newsletter subscribe signup", "form"), ("form", "", "form"), ("form", "search search-form", "form"), ("form", "login", "form"),
    ("div", "comments", "comments"), ("section", "comments comment-list", "comments"), ("div", "comment-thread responses replies discussion", "comments"), ("ol", "commentlist", "comments"), ("div", "disqus_thread", "comments"),
    ("div", "share social social-share", "links"), ("div", "tags tag-list", "links"), ("div", "pagination pager", "links"), ("div", "byline meta author-box", "short"), ("div", "toolbar skip-link", "links"),
]

#: Main-text containers.
MAINS = [
    ("article", ""), ("article", "post"), ("article", "article-body story"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "main-content article-content"), ("div", "post-content entry-content"),
    ("div", "article-body"), ("section", "article story-body"), ("div", "story text body-text"), ("div", "main"), ("div", "entry post"), ("div", ""), ("section", ""),
]


def _named(r: random.Random, words: str) -> str:
    """One of the class words, at times with a site's own prefix or a word of no meaning beside it."""
    if not words:
        return r.choice(["", "", "", "x-" + r.choice(WORDS)])
    word = r.choice(words.split())
    return r.choice([word, word, word, f"{r.choice(WORDS)}-{word}", f"{word}__{r.choice(WORDS)}", f"{r.choice(WORDS)} {word}"])


def _frame(r: random.Random, tag: str, words: str, holds: str):
    word = _named(r, words)
    if holds == "links":
        inner = [_links(r, "", r.randint(2, 7))] if r.random() < 0.7 else [("a", "", 0, _text(r, 2)) for _ in range(r.randint(1, 4))]
    elif holds == "short":
        return (tag, word, 0, _text(r, r.randint(2, 12)))
    elif holds == "long":
        inner = [("p", "", 0, _text(r, r.randint(10, 60))) for _ in range(r.randint(1, 3))]
    elif holds == "site":
        name = (r.choice(["h1", "h1", "h2", "p", "div", "span"]), "", 0, r.choice([_text(r, r.randint(1, 4)), [("a", "", 0, _text(r, 2))]]))
        inner = [name, ("nav", "", 0, [_links(r, "", r.randint(2, 6))]) if r.random() < 0.6 else _links(r, "", r.randint(2, 6))]
    elif holds == "form":
        inner = [("label", "", 0, _text(r, 2)), ("button", "", 0, _text(r, 1)), ("p", "", 0, _text(r, r.randint(1, 10)))][r.choice([0, 0, 1, 2]) :]
    elif holds == "comments":
        said = lambda: ("p", "", 0, _text(r, r.choice([1, 1, 2, 5, 20, 60])))
        inner = [("h3", "", 0, _text(r, 2))] if r.random() < 0.6 else []
        inner += [said() if r.random() < 0.4 and tag != "ol" else ("div" if tag != "ol" else "li", r.choice(["comment", ""]), 0, [said()]) for _ in range(r.randint(1, 5))]
    else:
        inner = [r.choice([("p", "", 0, _text(r, r.randint(2, 30))), ("h2", "", 0, _text(r, 2)), _links(r, "", 3), ("div", "", 0, _text(r, 5)), ("span", "", 0, _text(r, 3)), ("h1", "", 0, _text(r, 2))]) for _ in range(r.randint(1, 3))]
    return (tag, word, 0, inner)


def _main(r: random.Random, tag: str, words: str, depth: int = 0):
    word = _named(r, words)
    inner: list = [("h1", r.choice(["", "title", "headline"]), 1, _text(r, r.randint(2, 10)))] if r.random() < 0.8 else []
    if r.random() < 0.1:
        inner = [("header", "", 1, inner)] if inner else inner
    for _ in range(r.choice([1, 2, 4, 9])):
        x = r.random()
        if x < 0.7:
            n = r.choice([1, 2, 4, 20, 60, 120])
            inner.append(("p", "", 1, _text(r, n)) if r.random() < 0.75 else ("p", "", 1, [("b", "", 1, _text(r, n)), ("a", "", 1, _text(r, 2))]))
        elif x < 0.8:
            inner.append(("h2", "", 1, _text(r, 3)))
        elif x < 0.86:
            inner.append(("ul", "", 1, [("li", "", 1, _text(r, r.randint(1, 12))) for _ in range(3)]))
        elif x < 0.9:
            inner.append(("blockquote", "", 1, [("p", "", 1, _text(r, 12))]))
        elif x < 0.93:
            inner.append(("table", "", 1, [("tr", "", 1, [("td", "", 1, _text(r, 2)) for _ in range(2)]) for _ in range(2)]))
        elif x < 0.95:
            inner.append(("pre", "", 1, _text(r, 9)))
        elif x < 0.97:
            inner.append(("div", "", 1, _text(r, r.randint(3, 40))))
        else:
            inner.append(("figure", "", 1, [("figcaption", "", 1, _text(r, 6))]))
    for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
        inner.insert(r.randint(0, len(inner)), _frame(r, *r.choice([f for f in FRAMES if f[0] not in ("header",)])))
    if r.random() < 0.3:  # what readers add below the text
        inner.append(_frame(r, *r.choice([f for f in FRAMES if f[2] in ("comments", "form")])))
    return (tag, word, 1, inner)


def pages(n: int = 600, seed: int = 11) -> list[tuple]:
    """Labelled pages, the same ones each time: frames around one main text, at times wrapped in further divisions."""
    out = []
    for k in range(n):
        r = random.Random(seed * 1000 + k)
        main = _main(r, *MAINS[k % len(MAINS)])
        before = [_frame(r, *r.choice(FRAMES)) for _ in range(r.randint(1, 3))]
        after = [_frame(r, *r.choice(FRAMES)) for _ in range(r.randint(1, 4))]
        if k < len(FRAMES):
            after.append(_frame(r, *FRAMES[k]))
        mid = [main]
        for _ in range(r.choice([0, 0, 1, 2])):
            mid = [("div", r.choice(["", "wrapper", "container", "page", "row", "layout", "site"]), 2, [*mid, *([_frame(r, *r.choice(FRAMES))] if r.random() < 0.5 else [])])]
        if k % 9 == 4:  # a table that only lays out
            side = ("td", "", 0, [_links(r, "", r.randint(2, 6))] if r.random() < 0.4 else [("a", "", 0, _text(r, r.randint(1, 3))) for _ in range(r.randint(2, 6))])
            cell = ("td", "", 2, mid) if r.random() < 0.5 else ("td", "", 1, main[3])
            row = ("tr", "", 2, [side, cell] if r.random() < 0.7 else [cell, side])
            mid = [("table", "", 2, [row] if r.random() < 0.5 else [("tbody", "", 2, [row])])]
        body = ("body", "", 2, [*before, *mid, *after])
        if k % 12 == 11:  # a bare page: running text and nothing else
            body = ("body", "", 1, r.choice([_text(r, 30), _main(r, "div", "")[3]]))
        out.append(("html", "", body[2], [body]) if k % 3 else body)
    return out
