import html
import itertools
import re
import time

import numpy as np
import pytest

from tiersight.llm import html_text, queries
from tiersight.llm.sample_pages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return html_text.train(labelled_pages())


def plain_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())


def test_whole_table(spark, sf):
    pages = {r.page_id: r for r in queries.table(spark, sf, "pages").collect()}
    got = queries.op6_html_main_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        assert r.text == plain_article(pages[r.page_id].html)


def test_held_out_layouts(model):
    right = n = 0
    for page in labelled_pages(150, seed=77):
        marked, bare = html_text.parse(page), html_text.parse(page.replace(' data-y="1"', ""))
        want = html_text.text_of(marked, html_text.labels_of(marked).astype(float)).split()
        got = html_text.text_of(bare, html_text.content_marginals(model, [bare])[0]).split()
        right += len(set(want) & set(got))
        n += len(set(want) | set(got))
    assert right / n > 0.93


def test_layout_without_article(model):
    page = """<html><body><div class="navbar"><a href=/>Home</a> <a href=/x>News</a></div><header><h1>The Site</h1></header>
    <div class="cookie-notice"><p>We use cookies. They are good for you.</p></div>
    <div class="post-content"><h1>A &lt;title&gt;</h1><p>One  two\n<b>th</b>ree.<p>Four&nbsp;five &eacute;.<div class="ad">Buy this now.</div><p>Six<br>seven, and more words here.</p></div>
    <div class="sidebar"><h3>More</h3><ul><li><a href=/1>Other story</a></ul></div>
    <div id="comments"><h3>Comments</h3><p>First! This is what I think about it all.</p></div>
    <form><label>Your name</label><input></form><footer>&copy; 2020</footer><script>var x = "<p>no</p>";</script></body></html>"""
    assert html_text.main_texts(model, [page]) == ["A <title> One two three. Four five é. Six seven, and more words here."]


def test_head_ends_where_text_begins(model):
    text = "Words of the article that stand in its first paragraph, and some more."
    assert html_text.main_texts(model, [f"<html><head><title>No</title><article><p>{text}</article>"]) == [text]


def test_odd_pages(model):
    pages = [None, "", "<", "<!-- <p>never closed", "</p></div>", "<script>x", "<p title='a>b", "<div>" * 3000 + "deep", "a" * 200_000]
    got = html_text.main_texts(model, pages)
    assert len(got) == len(pages) and got[:2] == ["", ""] and got[3] == ""
    assert got[8] in ("", "a" * 200_000)


def test_nulls_and_clashing_names(spark):
    rows = [(1, None, None, 5), (None, "u", "<article><p>Some words are here.</p></article>", 6), (1, None, None, 5)]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("Some words are here.", 20)]
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(4)
    page = html_text.parse("<div><p>a<p>b<ul><li>c</ul></div><div><p>d</div>")
    n = len(page.elements)
    scores, pair = rng.normal(size=n), rng.normal(size=(2, 2))
    parents = [e.parent for e in page.elements]
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for y in itertools.product((0, 1), repeat=n):
        weight = np.exp(sum(s * v for s, v in zip(scores, y)) + sum(pair[y[p], y[i]] for i, p in enumerate(parents) if p >= 0))
        total += weight
        ones += weight * np.array(y)
        for i, p in enumerate(parents):
            if p >= 0:
                pairs[y[p], y[i]] += weight
    got, got_pairs = html_text.sum_product(html_text.forest([page]), scores, pair)
    assert np.allclose(got, ones / total) and np.allclose(got_pairs, pairs / total)


@pytest.mark.parametrize("piece", ["<a", "<a ", "<!--", "<!", '"', "<a \"", "<a '\">", "<a \"'>", "<div>", "<div></p>", "<p><li><x><ul>", "<b>", "</p>", "<script>", "<title></titl", "<p class='", "&amp", "<form>x", '<i ">"\''])
def test_odd_markup_is_read_in_time(model, piece):
    """Time in proportion to the page: a megabyte in seconds."""
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    parsed = html_text.parse(page)
    assert time.process_time() - began < 20
    assert max(e.depth for e in parsed.elements) <= html_text.DEEPEST
    html_text.main_texts(model, [page])
    assert time.process_time() - began < 90


def test_tags_end_as_quotes_say():
    names = lambda page: [(e.tag, e.marks) for e in html_text.parse(page).elements[1:]]
    assert names('<div title="a>b" class=menu><p data-x=\'>\'>') == [("div", ("menu",)), ("p", ())]
    assert names('<div title="a><p>') == [("div", ()), ("p", ())]
    assert html_text.parse("1 < 2 <3 <p>x</p").flow[-1][1] == "x"


@pytest.mark.parametrize("words", [4, 40, 400])
def test_forms_of_any_size_are_left_out(model, words):
    """A contact page: the form may hold more of the text than the article."""
    text = "The office is open on all days but one, and letters are answered within a week."
    fields = " ".join(f"<p>Please tell us about matter {i} in your own words.</p><input name=f{i}>" for i in range(words))
    page = f"<html><body><nav><a href=/>Home</a></nav><main><article><h1>Contact</h1><p>{text}</p></article><form>{fields}</form></main></body></html>"
    assert html_text.main_texts(model, [page]) == [f"Contact {text}"]
    wrapped = f"<html><body><form id=aspnet><nav><a href=/>Home</a></nav><article><h1>Contact</h1><p>{text}</p></article></form></body></html>"
    assert html_text.main_texts(model, [wrapped]) == [f"Contact {text}"]


PROSE = [
    "The mill by the river was built of grey stone and stood empty for years.",
    "In spring the owners opened it again, and the wheel turned for the first time in a century.",
    "Visitors come from the town on foot, and most of them stay until the evening.",
]


def test_articles_wrapped_in_forms(model):
    """Some servers put one form around a page or its content, with anything after it."""
    body = "".join(f"<p>{x} {x}</p>" for x in PROSE)
    want = " ".join(["The mill", *(f"{x} {x}" for x in PROSE)])
    for after in ("<div class=footer>(c) us</div>", "<footer>(c) us</footer>", "<div class=copyright><p>(c) us</p></div>", ""):
        page = f"<html><body><form id=aspnetForm><h1>The mill</h1>{body}</form>{after}</body></html>"
        assert html_text.main_texts(model, [page]) == [want], after
    inside = f"<html><body><form method=post><input type=hidden name=v value=1><nav><a href=/>Home</a> <a href=/n>News</a></nav><div class=content><h1>The mill</h1>{body}</div><footer>(c) us</footer></form></body></html>"
    assert html_text.main_texts(model, [inside]) == [want]


def test_forms_of_their_own_are_left_out(model):
    sign_in = "<html><body><form><label>Your name</label><input name=n><label>Your password</label><input name=p><button>Go</button></form></body></html>"
    assert html_text.main_texts(model, [sign_in]) == [""]
    body = "".join(f"<p>{x}</p>" for x in PROSE)
    page = f"<html><body><article><h1>The mill</h1>{body}<form class=newsletter><p>Get our letters by mail.</p><input name=m><button>Yes</button></form></article></body></html>"
    assert html_text.main_texts(model, [page]) == [" ".join(["The mill", *PROSE])]


def test_formulas_and_text_for_readers_without_scripts(model):
    page = f"<html><body><article><h1>Energy</h1><p>{PROSE[0]} It is <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> as they say.</p><p>{PROSE[1]}</p></article></body></html>"
    assert html_text.main_texts(model, [page]) == [f"Energy {PROSE[0]} It is E=mc2 as they say. {PROSE[1]}"]
    seen = html_text.parse("<p>a<noscript>b</noscript></p>")
    assert [v for _, v, _ in seen.flow if v] == ["a", "b"] and not any(e.unseen for e in seen.elements)
