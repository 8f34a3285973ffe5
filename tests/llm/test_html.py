"""Main text of pages: against the plain reading of labelled pages, with their labels hidden, and by hand."""

import html
import re

import pytest

from wordmill.llm import html_extract as hx
from wordmill.llm import queries

SF = "/root/testdata/sf0.001"
STORY = " ".join(f"word{k}" for k in range(40)) + "."


def plain(page):
    """The article of a test page, which has no other markup than p, h1, b and br."""
    start = page.index("<article>") + len("<article>")
    stop = page.find("</article>")
    body = re.sub(r"<[^>]*\Z", "", page[start:stop if stop >= 0 else len(page)])
    blocks = re.split(r"</?(?:p|h1)>", body)
    texts = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in blocks]
    return "\n".join(t for t in texts if t)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{SF}/pages.parquet")


@pytest.fixture(scope="module")
def weights(pages):
    return hx.learn_weights(pages)


def test_query_equals_plain_reading(spark, pages):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.op12_html_extract(spark, SF).collect()}
    want = {r.page_id: (r.url, plain(r.html), len(plain(r.html))) for r in pages.collect()}
    assert got == want


def test_labels_hidden(pages, weights):
    """Without their article element, pages that had no part in learning give the same text."""
    import pyarrow.parquet as pq
    others = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    bare = [hx.main_text(re.sub(r"</?article>", "", p), weights) for p in others]
    assert sum(b == plain(p) for b, p in zip(bare, others, strict=True)) >= 0.99 * len(others)


def test_weights_have_the_signs_of_the_method(weights):
    assert weights["word"] > 0 and weights["word:inside"] > 0
    assert all(w < 0 for k, w in weights.items() if not k.startswith("word"))
    assert weights["div"] < weights["p"]


def page(inside, before="", after=""):
    return (f"<!DOCTYPE html><html><head><title>Site name here</title><script>if (a < b) x('</p>')</script></head><body class='has-sidebar'>"
            f"<nav><ul><li><a href=/>Home</a></li></ul></nav>{before}{inside}{after}"
            f"<footer>All rights reserved by us</footer></body></html>")


def test_parts_set_apart(weights):
    inside = (f"<div id=content><h1>A title</h1><p>{STORY}</p><div class='ad-box'>buy now buy now</div><p>more &amp; more&nbsp;of\n it</p>"
              "<form><label>Your name</label><input name=n></form><aside>see also this</aside><p>the end<br>of it</p></div>")
    comments = "<section id=comments><p>first comment with very many words " + STORY + "</p></section>"
    cookie = "<div class=cookieNotice><p>We use cookies</p></div>"
    want = f"A title\n{STORY}\nmore & more of it\nthe end of it"
    assert hx.main_text(page(inside, before=cookie, after=comments), weights) == want
    assert hx.main_text(page(f"<main>{inside}</main>", before=cookie, after=comments), weights) == want
    side = "<div class=sidebar><ul><li><a href=x>Other story</a></li></ul></div>"
    assert hx.main_text(page(f"<article>{inside}</article>", before=side), weights) == want


def test_own_region_keeps_lists_and_links(weights):
    inside = f"<article><p>{STORY}</p><ul><li>one</li><li><a href=x>two</a></li></ul><p><a href=y>Read on</a></p></article>"
    assert hx.main_text(page(inside, after="<p>unrelated words here</p>"), weights) == f"{STORY}\none\ntwo\nRead on"


def test_markup_that_is_not_well_formed():
    w = hx.DEFAULTS
    assert hx.main_text("a < b and <b>c</b>d &lt;i&gt; &copy 5 &#65;", w) == "a < b and cd <i> © 5 A"
    assert hx.main_text("<p>one<p>two<div>three</p>four", w) == "one\ntwo\nthree\nfour"
    assert hx.main_text("<p>some words of a text <a title='x > y'>link</a> more <foot", w) == "some words of a text link more"
    assert hx.main_text("<p>kept<!-- not <p>this --> too <script>never closed", w) == "kept too"
    assert hx.main_text("text <!-- open", w) == "text"
    assert hx.main_text("<title>T</title><p class=x hidden>no</p><p>yes yes</p>", w) == "yes yes"
    assert hx.main_text("&amp;lt;", w) == "&lt;"


def test_best_stretch():
    assert hx.best_stretch([]) is None and hx.best_stretch([-1.0]) is None
    assert hx.best_stretch([1, -2, 3, -1, 3, -9, 4]) == (2, 4)
    assert hx.best_stretch([2, -5, 2]) == (0, 0)


def test_edges(spark, weights):
    schema = "page_id long, url string, html string, text string, `a.b` int"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (3, "u", "<nav>only a menu</nav>", "x", 1),
            (None, "u", "<p>plain words</p>", "x", 1), (4, "u", "<p>plain words</p>", "x", 1), (4, "u", "<p>plain words</p>", "x", 1),
            (5, "u", "<article>" + "<p>é è</p>" * 100_000, "x", 1), (6, "u", "<" * 5_000 + "a \"" * 5_000, "x", 1),
            (7, "u", "<b><div>" * 3_000 + "deep", "x", 1)]
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in hx.extract(spark.createDataFrame(rows, schema), weights).collect()), key=str)
    by = {r[0]: r for r in got}
    assert len(got) == 9 and by[1] == (1, "u", "", 0) and by[2] == (2, None, "", 0) and by[3] == (3, "u", "", 0)
    assert by[None] == (None, "u", "plain words", 11) and [r for r in got if r[0] == 4] == [(4, "u", "plain words", 11)] * 2
    assert by[5][2] == "\n".join(["é è"] * 100_000) and by[7][2] == "deep"
    empty = spark.createDataFrame([], schema)
    assert hx.extract(empty, hx.learn_weights(empty)).collect() == [] and hx.learn_weights(empty) == hx.DEFAULTS
