"""Minimum cuts against all labellings, and main text of hand-made and given pages."""

import html
import itertools
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gaugeline.llm import html_text as ht

chains = st.integers(1, 8).flatmap(
    lambda n: st.tuples(
        st.lists(st.integers(-40, 40), min_size=n, max_size=n),
        st.lists(st.integers(0, 30), min_size=2 * n, max_size=2 * n),
    )
)


@settings(deadline=None)
@given(chains)
def test_labels_reach_the_least_cost_of_all_labellings(case):
    unary, w = case
    n = len(unary)
    links = [(i, i + g, w[2 * i + g - 1]) for g in (1, 2) for i in range(n - g) if w[2 * i + g - 1]]

    def cost(x):
        return sum(
            u if u > 0 and not a else -u if u < 0 and a else 0 for u, a in zip(unary, x, strict=True)
        ) + sum(k for i, j, k in links if x[i] != x[j])

    best = min(cost(x) for x in itertools.product((False, True), repeat=n))
    assert cost(ht.labels(unary, links)) == best == cost(ht.minimum_cut(unary, links))


LONG = "This is a sentence of the article that says a good deal about its subject, and then some more."
PAGES = {
    f"<article><h1>T&amp;A</h1><p>{LONG}<p>{LONG}</article><aside>{LONG}</aside><footer>&copy; x</footer>": f"T&A {LONG} {LONG}",
    f"<div class='cookie-notice'>We use cookies.</div><div id=content><p>a&nbsp; b\n c {LONG}</p></div>": f"a b c {LONG}",
    f"<header><a href='/'>Home</a></header><main><header><h1>Head</h1></header><p>{LONG}</p><form>Name</form>"
    f"<section class=comments><p>{LONG}</p></section></main>": f"Head {LONG}",
    f"<body><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{LONG}</p><p>Short.</p><p>{LONG}</p></body>": f"{LONG} Short. {LONG}",
    f"<p>{LONG}<script>var a = '</p><p>no';</script><style>p{{}}</style><!-- {LONG} --> end": f"{LONG} end",
    "plain text without tags, a whole sentence.": "plain text without tags, a whole sentence.",
    "": "", "<html><head><title>x</title></head></html>": "", "<p": "<p", "< 3 &lt;3 and more words in here.": "< 3 <3 and more words in here.",
}


ART = f"<article><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></article>"
TEXT = f"Head {LONG} {LONG}"
PAGES |= {
    f"<div class='layout has-sidebar'>{ART}<div class='sidebar'><p>{LONG}</p></div></div>": TEXT,
    f"<html class='wp-toolbar'><body class='search no-footer'>{ART}</body></html>": TEXT,
    f"<form id=aspnetForm><div class=menu><a href=x>One</a></div>{ART}</form>": TEXT,
    f"<form id=aspnetForm><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div></form>": TEXT,
    f"<div class='sidebar-layout'>{ART}</div>": TEXT,
    f"<article><h1>Head</h1><section id='related-work'><h2 id='search-results'>Work.</h2><p>{LONG}</p></section></article>": f"Head Work. {LONG}",
    f"<article><p>{LONG} <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p></article>": f"{LONG} x=2",
    f"<main>x</main>" + f"<p>{LONG}</p>" * 30: " ".join(["x", *[LONG] * 30]),
}


@pytest.mark.parametrize("page", PAGES)
def test_pages(page):
    assert ht.main_text(page) == PAGES[page]


def test_long_and_broken_pages():
    assert ht.main_text("<div><b>" * 3_000 + LONG + "</i>" * 3_000) == LONG
    many = "<article>" + f"<p>{LONG}" * 5_000
    assert ht.main_text(many) == " ".join([LONG] * 5_000)
    assert len(ht.main_text("<p>ab" * 3_000)) in (0, 3 * 3_000 - 1)


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(None, None, None), (-1, "u", ""), (-1, "u", "")]
    pages = pages.unionAll(spark.createDataFrame(rows, pages.schema)).selectExpr("*", "1 AS text", "2 AS n_chars")
    source = {r.page_id: r.html for r in pages.collect()}
    got = ht.extract(pages).collect()
    assert len(got) == len(source) + 1
    for r in got:
        article = re.search(r"(?s)<article>(.*)</article>", source[r.page_id] or "")
        parts = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article[1])) if article else []
        texts = (re.sub(r"\s+", " ", html.unescape(p)).strip() for p in parts)
        assert r.text == " ".join(t for t in texts if t) and r.n_chars == len(r.text)


@pytest.mark.parametrize("unit", ['<a title="x ', "<a b='", "<div class=\"a' ", "<", "<!-- ", "</p", "<p><b>", '<a "\'>'])
def test_broken_markup_takes_linear_time(unit):
    started = time.perf_counter()
    ht.blocks(unit * (500_000 // len(unit)))
    assert time.perf_counter() - started < 4


def test_large_cuts():
    rng = random.Random(1)
    unary = [rng.randint(-40, 40) for _ in range(20_000)]
    links = [(i, i + g, rng.randint(1, 30)) for g in (1, 2) for i in range(len(unary) - g)]
    started = time.perf_counter()
    found = ht.minimum_cut(unary, links)
    assert 0 < sum(found) < len(found) and time.perf_counter() - started < 20


def test_flow_decides_what_is_not_certain(spark, monkeypatch):
    """Every block of the given pages that is not certain goes through the flow."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect() if r.html]
    seen, cut = [], ht.minimum_cut
    monkeypatch.setattr(ht, "minimum_cut", lambda unary, links: seen.append(len(unary)) or cut(unary, links))
    blocks = 0
    for page in pages:
        ht.main_text(page)
        blocks += sum(not b.sure for b in ht.blocks(page))
    assert len(seen) == len(pages) and sum(seen) == blocks > len(pages)


def test_neighbours_outweigh_a_block_s_own_cost():
    page = f"<div><p>{LONG}</p><p>{LONG}</p><p><a href=x>See also this page</a></p><p>{LONG}</p><p>{LONG}</p></div>"
    found = ht.blocks(page)
    unary = [ht.costs(b, ht.Page.of(found)) for b in found]
    assert [u > 0 for u in unary] == [True, True, False, True, True] and all(ht.labels(unary, ht.edges(found)))
    assert ht.main_text(page) == f"{LONG} {LONG} See also this page {LONG} {LONG}"
