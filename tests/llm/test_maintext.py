import html as entities
import itertools
import random
import re

import numpy as np
import pytest

from colsight.llm import maintext

SF = "/root/testdata/sf0.001"


def brute_article(page):
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_documents_pages_give_their_articles(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = maintext.op8_mincut_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == brute_article(pages[r.page_id].html)
        assert (r.n_chars, r.url) == (len(r.text), pages[r.page_id].url)


def test_cut_is_the_cheapest_labelling():
    random.seed(5)
    for _ in range(150):
        n = random.randint(1, 7)
        places = [random.randint(-6, 6) / 2 for _ in range(n)]
        chains = [(a, b, random.randint(0, 4) / 2) for a in range(n) for b in range(a) if random.random() < 0.5]
        cost = lambda x: sum(max(0, p) * (not c) + max(0, -p) * c for p, c in zip(places, x)) + sum(w for a, b, w in chains if x[a] != x[b])  # noqa: E731, B023
        least = min(cost(x) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(maintext.cut(places, chains)) - least) < 1e-9


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="home">
<div id="cookie-notice"><p>We use cookies on this long sentence, really we do, and more.</p></div>
<header><h2>Site name</h2></header><div class="main-menu"><a href="/a">A</a> <a href="/b">B</a></div>
<div class="wrap"><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with a fair number of words in it,
<a href="x">and a link</a>, to be kept whole.</p><div class="ad-box">Buy now, buy this great thing today.</div>
<ul><li>An item of the text that also says something worth keeping, at length.</li></ul><p>Last one &lt;b&gt; is here, and it has several words too.</p>
<form><label>Your mail</label><input></form></div>
<aside>Other things that one may like to read, many of them.</aside>
<section id="comments"><p>I am a reader and I comment at length here, very much so.</p></section>
<script>var a = "<p>not text</p>";</script><footer>&copy; someone</footer></body></html>"""


def test_boilerplate_of_many_kinds_goes_and_the_article_stays():
    text = maintext.extract(PAGE, maintext.PRIOR)
    assert text.split("\n") == [
        "A title & more",
        "First paragraph with a fair number of words in it, and a link, to be kept whole.",
        "An item of the text that also says something worth keeping, at length.",
        "Last one <b> is here, and it has several words too.",
    ]


ARTICLE = "<article><header class='entry-header'><h1>The title</h1></header>" + "".join(
    f"<p>Paragraph number {k} of the article has enough words to be one, and it ends.</p>" for k in range(8)
) + "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>"


@pytest.mark.parametrize(
    "wrapper",
    [
        '<body class="home no-sidebar">{}</body>', '<body class="nav-open">{}</body>', '<div class="content has-sidebar">{}</div>',
        '<div class="layout with-header">{}</div>', '<div id="social-network-page">{}</div>', '<form id="aspnetForm">{}</form>',
        '<div class="widget-area"><main>{}</main></div>', '<div class="popup"><div class="post">{}</div></div>',
    ],
)
def test_names_around_an_article_do_not_take_it_away(wrapper):
    page = wrapper.format('<nav><a href="/">Home</a></nav>' + ARTICLE + '<footer>The end of the page, with words.</footer>')
    lines = maintext.extract(page, maintext.PRIOR).split("\n")
    assert lines[0] == "The title" and lines[-1] == "So x=2 holds." and len(lines) == 10


def test_articles_in_navigation_and_comments_stay_boilerplate():
    comment = "<article><p>I have read this, and I do have something long to say about it, indeed.</p></article>"
    for place in ('<section id="comments">{}</section>', "<aside>{}</aside>", '<ol class="comment-list">{}</ol>', "<footer>{}</footer>"):
        assert "something long" not in maintext.extract(f"<body>{ARTICLE}{place.format(comment)}</body>", maintext.PRIOR)


def test_names_are_weighed_against_the_block():
    inner = "<div class='entry-content'><p>" + "Many words of a text that goes on and on and says things. " * 30 + "</p></div>"
    assert maintext.extract(f"<div class='sharing'>{inner}</div>", maintext.PRIOR)
    assert not maintext.extract("<div class='sharing'><p>Share this page</p></div>", maintext.PRIOR)


def test_broken_pages_do_not_crash():
    for page in ("", "<", "<p", "</div></p>", "<!-- x", "<script>", "<p>a<p>b</article>", "plain & simple words that stand alone here.", "<a href='x>y</a>", "<p class=>x", "\x00<p>é"):
        maintext.extract(page, maintext.PRIOR)
    assert maintext.extract("<article><p>a<b>b</p>c<script>x</article>", maintext.PRIOR) == "ab\nc"
    assert maintext.extract("<article>" + "<p>x y</p>" * 3000 + "</article>", maintext.PRIOR).count("\n") == 2999


def test_nulls_repeated_rows_and_empty_tables(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (1, None, "<article>x</article>", "t"), (None, "v", "", "t")], "page_id long, url string, html string, text string")
    weights = maintext.fit(pages)
    assert sorted(((r.page_id, r.url, r.text) for r in maintext.main_text(pages, weights).collect()), key=repr) == sorted([(1, "u", ""), (1, None, "x"), (None, "v", "")], key=repr)
    assert maintext.main_text(pages.limit(0), maintext.fit(pages.limit(0))).count() == 0
    assert np.array_equal(maintext.fit(pages.limit(0)), maintext.PRIOR)
