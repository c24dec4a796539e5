"""Main text of pages in layouts that the model was not trained on, hostile pages, and the cost of long ones."""

import time

import pytest

from vellumspark.llm import html

TEXT = "The river rises slowly in spring and the valley farms wait for it with some patience."
MORE = "In the dry years the mill stands still, and its owner keeps bees on the southern slope."

LAYOUTS = {
    "form and comments in the article": (
        f'<main><article><h1>Rivers</h1><p>{TEXT}</p><form><p>Name</p></form><p>{MORE}</p><section id="reader-comments"><p>Great!</p></section></article></main>',
        f"Rivers\n{TEXT}\n{MORE}",
    ),
    "magazine": (
        f'<body><div id="top"><nav><a href="/">Home</a><a href="/b">Books</a></nav></div><div id="wrap"><div class="story-main"><h1>Rivers</h1><div class="advert">Buy boots now</div><p>{TEXT}</p><aside class="related-links"><a>Other</a></aside><p>{MORE}</p></div><div id="sidebar"><h3>Popular</h3><ul><li><a>One</a></li></ul></div></div><footer>Imprint</footer></body>',
        f"Rivers\n{TEXT}\n{MORE}",
    ),
    "lists and tables count": (
        f"<body><header><a>Logo</a></header><article><h2>Rivers</h2><p>{TEXT}<ul><li>First point of some weight<li>Second point of some weight</ul><table><tr><td>Length<td>90 miles</table></article><footer><p>All rights reserved</p></footer></body>",
        f"Rivers\n{TEXT}\nFirst point of some weight\nSecond point of some weight\nLength\n90 miles",
    ),
    "cookie notice and scripts": (
        f'<html><head><title>t</title><style>p{{}}</style></head><body><div class="cookie-consent"><p>We use cookies to make this site work for you and for others.</p></div><script>var a="<p>no</p>";</script><main><p>{TEXT}</p><p>{MORE}</p></main></body></html>',
        f"{TEXT}\n{MORE}",
    ),
    "comment thread after the post": (
        f'<body><div class="post"><h1>Rivers</h1><div class="entry-content"><p>{TEXT}</p><blockquote><p>{MORE}</p></blockquote></div></div><div id="comments"><h3>2 comments</h3><div class="comment"><p>{MORE} I agree in full with this.</p></div></div></body>',
        f"Rivers\n{TEXT}\n{MORE}",
    ),
    "a site's name in a header without classes": (f'<header><h1>Site</h1><nav><a href="/a">News</a> <a href="/b">Sport</a></nav></header><main><h1>Rivers</h1><p>{TEXT}</p><p>{MORE}</p></main>', f"Rivers\n{TEXT}\n{MORE}"),
    "a header inside the article": (f"<body><header><h1>The Daily</h1><ul><li><a>Home</a><li><a>World</a></ul></header><article><header><h1>Rivers</h1></header><p>{TEXT}</p><p>{MORE}</p></article></body>", f"Rivers\n{TEXT}\n{MORE}"),
    "a table that lays out": (f'<body><table><tr><td><a href="/a">A</a> <a href="/b">B</a></td><td><h1>Rivers</h1><p>{TEXT}</p><p>{MORE}</p></td></tr></table></body>', f"Rivers\n{TEXT}\n{MORE}"),
    "a table that lays out, links on the right": (f'<body><table><tbody><tr><td><div><h2>Rivers</h2><p>{TEXT}</p><p>{MORE}</p></div></td><td><ul><li><a>One</a></li><li><a>Two</a></li></ul></td></tr></tbody></table><p>{MORE}</p></body>', f"Rivers\n{TEXT}\n{MORE}\n{MORE}"),
    "entities, breaks, blanks": (f"<article><p>One &amp; two&nbsp;three<br>four\n\t five &#233;</p><p>{TEXT}</p></article>", f"One & two three four five é\n{TEXT}"),
}


@pytest.fixture(scope="module")
def model():
    return html.fitted()


@pytest.mark.parametrize("depth", [390, 398, 500, 50_000])
@pytest.mark.parametrize("tag", ["div", "font", "section"])
def test_depth_takes_nothing(model, depth, tag):
    page = f"<article><h1>Rivers</h1><p>{TEXT}</p><p>{MORE}</p></article>"
    for end in (f"</{tag}>" * depth, ""):
        assert html.texts(model, [f"<body><nav><ul><li><a>Home</a></ul></nav>{f'<{tag} class=x>' * depth}{page}{end}"]) == [f"Rivers\n{TEXT}\n{MORE}"]


def test_messages_from_element_to_element_are_the_same(model, monkeypatch):
    sources = [LAYOUTS[k][0] for k in LAYOUTS]
    flat = model.marginals([html.parse(s) for s in sources])
    monkeypatch.setattr(html, "DEEP", 0)
    for a, b in zip(flat, model.marginals([html.parse(s) for s in sources]), strict=True):
        assert abs(a - b).max() < 1e-6


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(model, name):
    source, want = LAYOUTS[name]
    assert html.texts(model, [source]) == [want]


HOSTILE = {
    "open quotes": '<a"' * 330_000, "open comments": "<!--" * 250_000, "signs": "<" * 1_000_000, "deep": "<div>" * 200_000, "tags without end": "<a " * 330_000 + ">",
    "raw": "<script>" * 60_000 + "</scrip" * 60_000, "quotes at the end": '<x y="' * 160_000 + ">" + '"' * 1000, "paragraphs": "<p>" * 100_000, "lists": "<ul><li>" * 100_000, "wrong ends": "<b></i>" * 100_000,
}


@pytest.mark.parametrize("name", sorted(HOSTILE))
def test_hostile_pages(model, name):
    began = time.process_time()
    html.texts(model, [HOSTILE[name]])
    assert time.process_time() - began < 5


def test_attributes_of_pages_are_no_labels(model):
    assert html.texts(model, ['<article data-k="abc"><p data-k="">x y z</p></article>']) == html.texts(model, ["<article><p>x y z</p></article>"])
    assert html.parse('<p data-k="1">x</p>').labels == [-1, -1] and html.parse('<p data-k="1">x</p>', labelled=True).labels == [-1, 1]


def test_implied_ends():
    tags = lambda s: [(p.tags[i], p.tags[p.parents[i]]) for p in [html.parse(s)] for i in range(1, len(p.tags))]
    assert tags("<ul><li>a<li>b<ul><li>c</ul></ul>") == [("ul", "#"), ("li", "ul"), ("li", "ul"), ("ul", "li"), ("li", "ul")]
    assert tags("<table><tr><td>a<td>b<tr><td><p>c<table><tr><td>d</table></table>") == [("table", "#"), ("tr", "table"), ("td", "tr"), ("td", "tr"), ("tr", "table"), ("td", "tr"), ("p", "td"), ("table", "td"), ("tr", "table"), ("td", "tr")]
    assert tags("<p>a<div>b</div><dl><dt>c<dd>d<dt>e</dl>") == [("p", "#"), ("div", "#"), ("dl", "#"), ("dt", "dl"), ("dd", "dl"), ("dt", "dl")]
