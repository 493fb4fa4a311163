import html
import re
from itertools import product

import numpy as np
import pytest

from tallyloom.llm import htmltext as H
from tallyloom.llm.labelledpages import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.fit(labelled_pages(H.PAGES))


def texts(page):
    return [b.text for b in H.blocks_of(page)]


def tags(page):
    return [" ".join(e[0] for e in b.path) for b in H.blocks_of(page)]


def test_blocks():
    assert texts("<p>a <b>b</b>\n c<br>d<p>e") == ["a b c d", "e"]
    assert texts("x &amp;amp; &lt;g&gt; &#233;&nbsp;&nosuch; 1 < 2 > 1") == ["x &amp; <g> é &nosuch; 1 < 2 > 1"]
    assert texts('<head><title>t</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>in') == ["in"]
    assert texts("<title>t<p>no</title><p>a<!-- <p>no</p> --> b <!-- never closed <p>no") == ["a b"]
    assert texts("<p>a<script>if (a </b) x") == ["a"]
    assert texts("<head><meta x><p>a") == ["a"]
    assert texts('<a title="1 > 0" href=\'">"\'>a</a><textarea>no</textarea><svg><text>no</text></svg>b') == ["a", "b"]
    assert texts("") == texts("   \n") == texts("<!DOCTYPE html><br><img>") == []
    assert tags("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>") == ["ul li", "ul li ul li", "ul li ul li", "ul li"]
    assert tags("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table>e") == ["table tr td", "table tr td", "table tr th", "table tr th table tr td", "table tr th"]
    assert tags("<div><p>a<b>b<div>c</p>d</div>e") == ["div p", "div div", "div div", "div"]
    assert tags("<h1>a<h2>b<p>c</h2>d") == ["h1", "h2", "h2 p", ""]
    assert [b.path[0][1] for b in H.blocks_of('<div class="post-Body wideText" id=main2 hidden>a</div>')] == [("post", "body", "wide", "text", "main", "hidden")]
    assert [round(b.linked, 2) for b in H.blocks_of("<p>ab<a href=x>cd</a></p><p><a>x</p><p>y</a>")] == [0.5, 1.0, 0.0]


def test_sums_and_viterbi_equal_enumeration():
    rng = np.random.default_rng(0)
    sizes = np.array([1, 2, 5, 4])
    score, step = np.zeros((4, 5, 2)), rng.normal(size=(4, 4, 2, 2))
    score[:, :, 1] = rng.normal(size=(4, 5))
    total, node, pair = H.log_sums(score, step, sizes)
    for p, n in enumerate(sizes):
        ways = list(product((0, 1), repeat=int(n)))
        value = np.array([sum(score[p, k, y[k]] for k in range(n)) + sum(step[p, k, y[k], y[k + 1]] for k in range(n - 1)) for y in ways])
        chance = np.exp(value - np.logaddexp.reduce(value))
        assert np.isclose(total[p], np.logaddexp.reduce(value))
        for k in range(n):
            assert np.isclose(node[p, k, 1], sum(c for c, y in zip(chance, ways, strict=True) if y[k]))
        for k in range(n - 1):
            assert np.isclose(pair[p, k, 1, 0], sum(c for c, y in zip(chance, ways, strict=True) if y[k : k + 2] == (1, 0)))
        assert not node[p, n:].any() and not pair[p, n - 1 :].any()
    for seed in range(30):
        rng = np.random.default_rng(seed)
        blocks = [H.Block(f"b{k}", tuple((t, ()) for t in rng.choice(["div", "p", "h1"], rng.integers(0, 3))), 0.0, False) for k in range(6)]
        f = H.Field({}, rng.normal(size=(H.EDGES, 2, 2)))
        own = rng.normal(size=6).tolist()
        f.emissions = lambda _, own=own: own
        kinds = [H.edge_of(a, b) for a, b in zip(blocks, blocks[1:], strict=False)]
        best = max(product((False, True), repeat=6), key=lambda y: sum(s for s, v in zip(own, y, strict=True) if v) + sum(f.edges[k][int(a)][int(b)] for k, a, b in zip(kinds, y, y[1:], strict=False)))
        assert f.labels(blocks) == list(best)


def test_held_out_layouts(model):
    right = shown = main = both = 0
    pages = labelled_pages(300, seed=5)
    for page, text in pages:
        got, want = model.main_text(page).split("\n\n"), text.split("\n\n")
        right += got == want
        shown, main, both = shown + len(got), main + len(want), both + len(set(got) & set(want))
    assert right / len(pages) > 0.88 and both / shown > 0.98 and both / main > 0.98


def test_layouts_of_other_making(model):
    long = "Many words of an article that goes on for a while, with commas, and an end. " * 3
    comment = "I have read this article twice and still think, with all respect, that the author is wrong."
    page = f"""<html><body><header class="site-header"><a href=/>Daily</a><p>The paper of record</p></header><nav class=menu><ul><li><a>Home</a><li><a>News</a></ul></nav>
    <div class="cookie-banner"><p>We use cookies to improve our site.</p><button>Accept</button></div>
    <main><article class="post"><h1>A title</h1><p>{long}</p><aside class="advert"><p>Buy our soap now.</p></aside><h2>Short part</h2><p>One.</p><ul><li>first item</li><li>second item</li></ul><p>{long}</p></article>
    <section id="comments"><h3>Comments</h3><div class="comment"><b>Ann</b><p>{comment}</p></div></section></main>
    <aside class="sidebar"><h3>Most read</h3><ul><li><a>Other story</a></ul></aside><form class="newsletter"><p>Get our letter.</p><input></form>
    <footer><p>&copy; 2024 Daily</p><p>All rights reserved.</p></footer><script>x()</script></body></html>"""
    assert model.main_text(page) == "\n\n".join(["A title", long.strip(), "Short part", "One.", "first item", "second item", long.strip()])
    plain = f'<body><div id="menu"><a href=1>One</a> <a href=2>Two</a></div><div id="content"><h1>T</h1><p>{long}<p>{long}</div><div id="footer">&copy; me</div>'
    assert model.main_text(plain) == "\n\n".join(["T", long.strip(), long.strip()])


def test_query_over_its_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r for r in H.op13_html_text(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:  # these pages mark their article by its tag, and hold p, b, br and h1 alone in it
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"</?b>|<br>", "", s)).split()) for s in re.split(r"</?(?:p|h1)>", inside)]
        assert (got[r.page_id].url, got[r.page_id].text) == (r.url, "\n\n".join(s for s in want if s))
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_odd_rows(spark, model):
    long = "<article>" + "<p>word and more words.</p>" * 60_000
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (None, "u", "<nav><a href=x>a</a></nav>", "t"), (4, "u", long, "t"), (4, "u", long, "t"), (5, "u", "<p>" * 50_000, "t"), (6, "u", "<div>x" * 30_000, "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(df, model).collect()
    assert [(r.page_id, r.url) for r in got] == [(r[0], r[1]) for r in rows]
    assert [r.text for r in got[:3]] == ["", "", ""] and got[3] == got[4] and got[3].n_chars == 60_000 * 22 - 2 and got[5].text == ""
    assert H.extract(df.limit(0), model).count() == 0
    assert H.fit([]).main_text("<p>a") == ""
    with pytest.raises(ValueError):
        H.fit([("<p>a", "b")])
