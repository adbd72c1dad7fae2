"""Main text of pages: written pages, broken markup, marginals against enumeration."""

import itertools
import math
import random

import pytest

from salestide.llm import pages

LONG = "Many words stand here, one after the other, so that the block reads like a paragraph of the article itself."
PAGE = """<!DOCTYPE html><html lang="en"><head><title>T</title><style>p{{x}}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News &amp; more</a></li></ul></nav><div class="ad">Buy now.</div>
<article><h1>Head</h1><p>{0} First.<p>{0} Second &lt;x&gt;<br> end.</article>
<footer>&copy; site &middot; all</footer></body></html>"""


@pytest.fixture(scope="module")
def potentials(spark):
    rows = [(i, PAGE.format(LONG + f" Number {i}.")) for i in range(40)]
    return pages.fit(spark.createDataFrame(rows, "page_id long, html string"))


def test_article(potentials):
    got = pages.main_text(PAGE.format(LONG), potentials)
    assert got == f"Head\n{LONG} First.\n{LONG} Second <x> end."


def test_pages_without_semantic_elements(potentials):
    html = f"""<body><div id="top-menu"><ul><li><a href=1>Home</a><li><a href=2>Shop</a></ul></div>
    <div class="cookie-notice">We use cookies. <button>OK</button></div>
    <div class="post-content"><h2>Title</h2><p>{LONG}</p><p>{LONG} <a href=x>More</a> to say.</p>
    <form><label>Mail</label><input><button>Send</button></form></div>
    <div class="sidebar"><p>Other things you may like, and some more of them here.</p></div>
    <div id="comments"><p>{LONG} says a reader.</p></div><div class="footer">Legal</div></body>"""
    assert pages.main_text(html, potentials) == f"Title\n{LONG}\n{LONG} More to say."


def test_furniture_inside_the_article(potentials):
    html = f"<main><h1>A</h1><p>{LONG}</p><aside>Aside text</aside><div class='share'>Share this</div><p>{LONG}</p><footer>by me</footer></main>"
    assert pages.main_text(html, potentials) == f"A\n{LONG}\n{LONG}"


@pytest.mark.parametrize("html", [None, "", "<", "<p", "text only", "<!--", "<script>", "</p></div>", "<a href='x", "<p>" * 3000, "<div>" * 3000 + "x"])
def test_broken_markup(potentials, html):
    assert isinstance(pages.main_text(html, potentials), str)


def test_long_broken_page_takes_linear_time(potentials):
    for part in ("<p>x", "<a href=\"", "<!--", "<b", "&amp;", "</i>", "<li>x"):
        pages.main_text(part * 40_000, potentials)


def test_marginals_match_enumeration(potentials):
    rnd = random.Random(2)
    kinds = sorted({*pages._KINDS.values(), "furniture"})
    for _ in range(20):
        n = 7
        parents = [-1] + [rnd.randrange(i) for i in range(1, n)]
        seen = [(rnd.choice(kinds), rnd.choice(["content", "none"]), rnd.choice(["none", "few", "most"]),
                 rnd.choice(["0", "short", "line", "long"])) for _ in range(n)]
        total, on = 0.0, [0.0] * n
        for states in itertools.product((0, 1), repeat=n - 1):
            states = (0, *states)
            weight = math.exp(sum(
                potentials.unary(seen[i])[states[i]] + potentials.step[seen[i][0], bool(states[parents[i]])][states[i]] for i in range(1, n)))
            total += weight
            for i in range(n):
                on[i] += weight * states[i]
        got = pages.marginals(parents, seen, potentials)
        assert all(abs(got[i] - on[i] / total) < 1e-9 for i in range(1, n))


def test_table_cases(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "<article><p>" + LONG + "</article>", "z"), (3, "<article><p>" + LONG + "</article>", "z"), (None, "<p>a", None)]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "html", "text"]
    assert [r.text for r in got.where("page_id = 3").collect()] == [LONG, LONG]
    assert [r.text for r in got.where("page_id < 3").collect()] == ["", ""]
    assert pages.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


@pytest.mark.parametrize("name", ["share-price-report", "legal-news", "form-guide", "menu-week", "share-price report"])
def test_names_that_only_hold_a_furniture_word(potentials, name):
    html = f"<body><nav><a href=1>Home</a></nav><article class='{name}'><h1>A</h1><p>{LONG}</p><section id='{name}'><h2>B</h2><p>{LONG}</p></section></article></body>"
    assert pages.main_text(html, potentials) == f"A\n{LONG}\nB\n{LONG}"


def test_weights_are_learned(spark):
    # where labelled pages hold their text in blocks named like this, such blocks are content
    named = "<body><div class='menu'><a href=1>Home</a></div><article><h1>A</h1><div class='disclaimer'><p>{0}</p><p>{0}</p></div><p>{0}</p></article></body>"
    rows = [(i, named.format(LONG + str(i))) for i in range(300)]
    learned = pages.fit(spark.createDataFrame(rows, "page_id long, html string"))
    assert pages.main_text(named.format(LONG), learned) == f"A\n{LONG}\n{LONG}\n{LONG}"


def test_held_out_pages_with_and_without_names(spark):
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect()
    known = pages.fit(spark.createDataFrame([(r.page_id, r.html) for r in rows[::2]], "page_id long, html string"))
    for strip in (False, True):
        right = whole = 0
        for r in rows[1::2]:
            html = re.sub(r"""\s(?:class|id|role)\s*=\s*("[^"]*"|'[^']*')""", "", r.html) if strip else r.html
            page = pages.Page(html)
            truth = pages.labels(page)
            if truth is None:
                continue
            found = pages.marginals(page.parents, page.observed(), known)
            for i in range(1, len(truth)):
                if page.length[i]:
                    right, whole = right + ((found[i] > 0.5) == truth[i]), whole + 1
        # without names an advert is a plain block of text before the article: one block a page is lost
        assert whole > 1000 and right / whole > (0.94 if strip else 0.99), (strip, right, whole)
