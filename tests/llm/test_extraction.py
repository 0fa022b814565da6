"""Main text of pages: the parser's cases, held-out accuracy on made pages, and the query against the article elements."""

import html as H
import random
import re

import numpy as np
import pytest

from wavemill.llm import main_text
from wavemill.llm.html_blocks import parse
from wavemill.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return main_text.train(main_text.training_pages([]))


def blocks(html):
    return parse(html).texts


def test_blocks_of_odd_markup():
    assert blocks(None) == blocks("") == blocks("   ") == blocks("<p></p><!-- a -->") == []
    assert blocks("a < b & c &amp; d &lt;p&gt; &eacute;&#233;&#xe9; &am") == ["a < b & c & d <p> ééé &am"]
    assert blocks("<p>one<p>two <b>bold<p>three</b></p>") == ["one", "two bold", "three"]
    assert blocks("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert blocks("x<br>y\n\t z&nbsp;w") == ["x y z w"]
    assert blocks("<script>var t='</p><p>no';</script>yes<style>p{}</style>") == ["yes"]
    assert blocks("<p title=\"a > b\" class='c'>t</p>") == ["t"]
    assert blocks("<p title=it's>t</p><p>u's</p>") == ["t", "u's"]
    assert blocks("</div></p>text</article><p>more<script>open") == ["text", "more"]
    assert blocks("cut <a href='x") == ["cut"]
    assert blocks("1 <2") == ["1 <2"]
    assert blocks("<table><tr><td>a<td>b<tr><th>c</table>") == ["a", "b", "c"]
    assert blocks("<p>a<!-- <p>b --> c<!-- open") == ["a c"]


def test_paths_names_and_links():
    page = parse("<body><div id='siteMenu' class='top-nav x1'><p role=note>a <a href=#>bc</a></p></div><article><h1>t</h1></article>")
    assert page.texts == ["a bc", "t"]
    assert page.link_chars == [2, 0]
    node = page.nodes[0]
    assert page.names[node] == ("<p>", "note")
    assert page.names[page.parents[node]] == ("<div>", "site", "menu", "top", "nav", "x")
    assert page.names[page.parents[page.nodes[1]]] == ("<article>",)


def test_long_and_deep_pages_are_linear(model):
    n = 20_000
    assert blocks("<div>" * n + "deep" + "</div>" * n) == ["deep"]
    assert blocks("<" * n) == ["<" * n]
    assert blocks("<a b='" * n) == []
    many = "".join(f"<p>Paragraph number {k} says something of the matter.</p>" for k in range(n))
    text = main_text.texts_of(model, [f"<nav><a href='/'>Home</a></nav><article>{many}</article><footer>&copy; x</footer>"])[0]
    assert text.startswith("Paragraph number 0") and text.count("\n\n") == n - 1


def test_gradients_agree_with_differences():
    pages = [parse("<nav><a>x y</a></nav><article><p>one two.</p></article>"), parse("<p class=ad>three</p>")]
    batch, labels = main_text.Batch(pages), np.array([0, 1, 0])
    m = main_text._weights(3)
    _, grads = main_text._gradients(m, batch, labels)
    rng = np.random.default_rng(0)
    for name in m:
        used = np.argwhere(grads[name] != 0)
        for at in map(tuple, used[rng.permutation(len(used))[:4]]):
            kept, losses = m[name][at], []
            for step in (1e-6, -1e-6):
                m[name][at] = kept + step
                losses.append(main_text._gradients(m, batch, labels)[0])
            m[name][at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - grads[name][at]) < 1e-6, name


def test_held_out_made_pages(model):
    maker, wrong, seen = main_text.Maker([], 4242), 0, 0
    for _ in range(200):
        html, labels = maker.page()
        page = parse(html)
        assert len(page.texts) == len(labels)
        found = main_text.probabilities(model, main_text.Batch([page])) >= main_text.THRESHOLD
        wrong += int((found != np.array(labels)).sum())
        seen += len(labels)
    assert wrong / seen < 0.03


HAND_MADE = [
    (
        "<html><head><title>T</title></head><body><header class='site-header'><h1>The Daily</h1><nav><ul><li><a href='/'>Home</a></li></ul></nav></header>"
        "<div class='cookie-banner'><p>We use cookies.</p><button>OK</button></div><main><article><h1>A great flood</h1><p>The river rose in the night "
        "and the town was cut off.</p><div class='ad'>Buy boats now, cheap.</div><p>Help came by noon.</p></article><section class='comments'><h2>Comments</h2>"
        "<div class='comment'><p>I was there and it was a terrible night, the water came up to the door.</p></div></section></main><aside class='sidebar'><h3>Related</h3>"
        "<ul><li><a href='/b'>Boats</a></li></ul></aside><footer>&copy; 2020 The Daily</footer></body></html>",
        "A great flood\n\nThe river rose in the night and the town was cut off.\n\nHelp came by noon.",
    ),
    (
        "<body><div id='nav'><a href='/a'>A</a> <a href='/b'>B</a></div><div id='content'><h1>Tea</h1><p>Tea is a drink made of leaves.</p><h2>Kinds</h2><ul>"
        "<li>Green tea</li><li>Black tea</li></ul></div><div id='comments'><ol class='comment-list'><li class='comment'>I like the green one best.</li></ol><form>"
        "<label>Name</label><textarea>Your comment</textarea><button>Send</button></form></div><div id='footer'>All rights reserved</div></body>",
        "Tea\n\nTea is a drink made of leaves.\n\nKinds\n\nGreen tea\n\nBlack tea",
    ),
]


@pytest.mark.parametrize("html, text", HAND_MADE)
def test_hand_made_pages(model, html, text):
    assert main_text.texts_of(model, [html]) == [text]


def article(html):
    inside = re.search(r"<article>(.*?)(?:</article>|$)", html, re.S)[1]
    parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(p for p in parts if p)


def test_query_gives_the_articles(spark, data):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    rows = QUERIES["op11_main_text_lstm"](spark, data).collect()
    assert len(rows) == len(html)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert [r["page_id"] for r in rows if r["text"] != article(html[r["page_id"]])] == []


def test_odd_tables(spark, model):
    kind = "page_id long, url string, html string, text string, n_chars int"
    empty = main_text.extract(spark.createDataFrame([], kind))
    assert empty.columns == ["page_id", "url", "text", "n_chars"] and empty.count() == 0
    page = "<nav><a>Home</a></nav><article><p>Words of the article, &amp; more.</p></article>"
    rows = [(1, "u", page, "x", 5), (1, "u", page, "x", 5), (None, None, None, None, None), (2, None, "", None, 1), ((1 << 60) + 1, "v", "<p></p>", "", 0)]
    random.Random(1).shuffle(rows)
    got = sorted(map(tuple, main_text.extract(spark.createDataFrame(rows, kind), model).collect()), key=repr)
    text = "Words of the article, & more."
    assert got == sorted([(1, "u", text, len(text))] * 2 + [(None, None, "", 0), (2, None, "", 0), ((1 << 60) + 1, "v", "", 0)], key=repr)
