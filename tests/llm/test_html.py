"""Main text of pages: layouts by hand, the cut against all labellings, and the tables' pages against their articles."""

from __future__ import annotations

import html
import itertools
import random
import re

import numpy as np
import pytest

from alertmill.llm import html_extract as hx

LONG = "The harbour was rebuilt after the storm, and the council kept the old lighthouse as a museum for the town."
MORE = "Fishing boats still leave before dawn, although fewer families live from the sea than a generation ago."

LAYOUTS = {
    "semantic": (
        f"""<html><body class="home has-sidebar comments-open"><header><h1>The Daily Net</h1><nav><a href=/>Home</a> <a href=/b>News</a></nav></header>
        <div class="cookie-banner"><p>{MORE}</p><button>Accept</button></div>
        <main><article><header><h2>A harbour returns</h2></header><p>{LONG}<p>Yes.</p><ul><li>one harbour</li><li>two boats, <a href=x>three</a> nets</li></ul>
        <aside class="pull">{MORE}</aside><blockquote><p>{MORE}</p></blockquote></article></main>
        <aside id="sidebar"><h3>Related</h3><ul><li><a href=1>Other story of the day, with a long title.</a></li></ul></aside>
        <section id="comments"><h3>2 comments</h3><article class="comment"><p>{LONG} I was there!</p></article></section>
        <footer>&copy; 2024 The Daily Net. All rights reserved.</footer></body></html>""",
        ["A harbour returns", LONG, "Yes.", "one harbour", "two boats, three nets", MORE],
    ),
    "divs": (
        f"""<body><div id="top-nav"><a href=/>Home</a> | <a href=/b>News</a></div><div class="wrapper"><div class="post-content entry"><h1>A harbour returns</h1>
        <p>{LONG}</p><div>{MORE}</div><p>Yes.</p></div><div class="leftSidebar"><p>{MORE} {MORE}</p></div>
        <div class="post-comments"><div class="comment-body"><p>{LONG} I was there!</p></div></div>
        <div class="newsletter-signup">{LONG}<input name=q></div><div class="site-footer"><p>Imprint, terms and {MORE}</p></div></div>""",
        ["A harbour returns", LONG, MORE, "Yes."],
    ),
    "one form around the page": (
        f"""<form id=aspnet><table><tr><td><a href=1>One</a><br><a href=2>Two</a></td><td><p>{LONG}</p><p>{MORE}</p><p>{LONG} {MORE}</p></td></tr></table></form>""",
        [LONG, MORE, f"{LONG} {MORE}"],
    ),
    "no names": (
        f"""<div><a href=1>One</a> <a href=2>Two</a> <a href=3>Three</a></div><div><h1>A harbour returns</h1><p>{LONG}</p><p>Yes.</p><p>{MORE}</p><p>{LONG} {MORE}</p></div><div><a href=4>Imprint</a> <a href=5>Terms</a> <a href=6>About us</a></div>""",
        ["A harbour returns", LONG, "Yes.", MORE, f"{LONG} {MORE}"],
    ),
    "layout names": (
        f"""<div class="content-with-sidebar"><div role="navigation">Skip to content</div><div class="main-text"><p>{LONG}</p><p style="display:none">{MORE} hidden</p><p>{MORE}</p></div><div role="alert"><p>{LONG} notice</p></div></div>""",
        [LONG, MORE],
    ),
    "parts of names": (
        f"""<div class="top-bar"><p>{MORE}</p></div><div id="page"><div class="sign-up"><p>{MORE}</p></div><div class="elementor-widget-text"><h1>A harbour returns</h1><p>{LONG}</p><p>{MORE} {LONG}</p></div>
        <div class="widget"><p>{MORE}</p></div><div id="aside"><p>{MORE}</p></div><ol class="commentlist"><li><p>{LONG} I was there!</p></li></ol><div id="disqus_thread"><p>{MORE}</p></div></div>""",
        ["A harbour returns", LONG, f"{MORE} {LONG}"],
    ),
    "an advert and a form in the text": (
        f"""<article><h1>A harbour returns</h1><p>{LONG}</p><div class="ad-slot"><p>{MORE}</p></div><form><label>Mail</label><input><p>{MORE}</p></form><p>Yes.</p><figure><img><figcaption>The new harbour.</figcaption></figure><p>{MORE}</p></article>""",
        ["A harbour returns", LONG, "Yes.", "The new harbour.", MORE],
    ),
    "broken": (
        f"""<article><h1>A &amp; B&nbsp;&eacute;<script>var x = "<p>no</p>";</script></h1><p><b>{LONG}<br><p><a href="x>y">a link</a> in &lt;text&gt; and more of it, as ever.</div></span><p>{MORE}<!-- <p>no</p> --></article><style>p{{}}</style><footer>x""",
        ["A & B é", LONG, "a link in <text> and more of it, as ever.", MORE],
    ),
    "unclosed": (f"<nav><ul><li><a href=1>One<li><a href=2>Two</ul></nav><main><p>{LONG}<p>{MORE}", [LONG, MORE]),
    "menu only": ("<nav><a href=1>One</a></nav><footer>&copy; x</footer>", []),
    "no page": ("", []),
    "tags only": ("<div><p></p><br></div><!-- x", []),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    markup, want = LAYOUTS[name]
    assert hx.main_text(markup).split("\n") == (want or [""])


def test_cut_is_the_least_of_all_labellings():
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 8)
        costs = [rng.randint(-6, 6) for _ in range(n)]
        edges = {(a, b): rng.randint(0, 5) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5}
        price = lambda side: sum(-c if c < 0 and s else c if c > 0 and not s else 0 for c, s in zip(costs, side)) + sum(w for (a, b), w in edges.items() if side[a] != side[b])  # noqa: B023, E731
        every = list(itertools.product((False, True), repeat=n))
        least = min(map(price, every))
        most = [any(side[i] for side in every if price(side) == least) for i in range(n)]
        assert hx.min_cut(costs, edges) == most


def test_labels_come_from_the_cut(monkeypatch):
    markup, want = LAYOUTS["semantic"]
    monkeypatch.setattr(hx, "min_cut", lambda costs, edges: [False] * len(costs))
    assert hx.main_text(markup) == ""


def test_ties_carry_short_blocks():
    """A short block without marks follows its neighbours; alone it is boilerplate."""
    pieces = hx.blocks_of("<div><div>Yes, so</div></div>")
    costs, edges = hx.network(pieces, hx.WEIGHTS)
    assert not hx.min_cut(costs, edges)[0]
    pieces = hx.blocks_of(f"<div><p>{LONG} {LONG}</p><div>Yes, so</div><p>{MORE} {LONG}</p></div>")
    costs, edges = hx.network(pieces, hx.WEIGHTS)
    assert hx.min_cut(costs, edges)[: len(pieces)] == [True, True, True]


def test_long_pages_end_soon():
    """Many blocks, deep nesting, and brackets that close nothing."""
    assert len(hx.main_text(f"<article>{f'<p>{LONG}</p>' * 20_000}</article>").split("\n")) == 20_000
    assert hx.main_text("<div>" * 20_000 + f"<p>{LONG} {MORE}") == f"{LONG} {MORE}"
    assert hx.main_text("<" * 200_000) is not None
    mixed = "".join(f"<p>{LONG}</p><div><a href=x>link {i}</a></div>" for i in range(5_000))
    assert LONG in hx.main_text(mixed)


def test_classifier_learns_from_marks():
    example = [((0, 3, 0, 0, 2, 0), 0, 4000), ((3, 0, 1, 1, 4, 0), 1, 4000)]
    w = hx.fitted(example)
    at = np.add((3, 0, 1, 1, 4, 0), hx.STARTS)
    assert w[at].sum() > hx.WEIGHTS[at].sum() and np.allclose(hx.fitted([]), hx.WEIGHTS)


def article_of(page: str) -> str:
    body = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", body[1]) if body else []
    return "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<(?:br|/?b)>", " ", p)).split()) for p in parts) if x)


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in hx.op12_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    want = {r.page_id: article_of(r.html or "") for r in pages.collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_odd_rows(spark):
    rows = [(1, "u", None, "x"), (None, None, LAYOUTS["divs"][0], "x"), (2, "u", "", "x"), (2, "u", "", "x"), (3, None, f"<p>{LONG}", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = hx.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r.page_id), r.text) for r in got.collect()) == sorted([("1", ""), ("None", "\n".join(LAYOUTS["divs"][1])), ("2", ""), ("2", ""), ("3", LONG)])
    assert hx.extract(pages.limit(0)).count() == 0
