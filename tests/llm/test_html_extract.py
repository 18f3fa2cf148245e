"""Pages by hand, message passing against enumeration, held-out accuracy on labelled pages."""

import itertools
import time

import numpy as np

from skeinwork.llm import html_extract as hx

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div class="cookie-notice"><p>We use cookies on this site.</p></div>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<article class="post-content"><h1>A &amp; B&#8217;s  day</h1><p>First <b>bold</b>
 paragraph of the   text, long enough to be read as text.<p>Second paragraph &lt;here&gt; with words that go on for a while, as text does.</p><script>var x = "<p>no</p>";</script>
<div class="ad banner">Buy now!</div></article><section class="comments"><p>I agree with all that was said.</p></section><aside class="sidebar"><p>Related</p></aside>
<form class="newsletter"><label>Subscribe</label><input name="q"></form><footer><p>&copy; 2024 All rights reserved</p></footer></body></html>"""


def test_a_page(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", "plain words & more"), (5, "x", "<p>" * 3000 + "deep"), (1, "u", PAGE), (6, "y", "<<<><!-- <p>never closed")], "page_id long, url string, html string").selectExpr("*", "'q' AS text", "1 AS _page")
    got = [r.asDict() for r in hx.extract(pages).collect()]
    assert len(got) == 7
    by_id = {r["page_id"]: r for r in got}
    want = "A & B’s day\n\nFirst bold paragraph of the text, long enough to be read as text.\n\nSecond paragraph <here> with words that go on for a while, as text does."
    assert by_id[1]["text"] == want and by_id[1]["n_chars"] == len(want)
    assert (by_id[2]["text"], by_id[3]["text"], by_id[2]["n_chars"]) == ("", "", 0)
    assert hx.extract(pages.limit(0)).count() == 0


def test_marginals_equal_enumeration():
    model = hx.trained()
    nodes = hx.tree_of("<div class='x'><p>a b c.</p><nav><a href='#'>q</a></nav><section><p>d e</p></section></div>")
    n, total, on = len(nodes), 0.0, np.zeros(len(nodes))
    features = hx.described(nodes)
    assert any(f.startswith("in ") for f in features[-1])
    for labels in itertools.product((0, 1), repeat=n):
        score = float(model.root[labels[0]])
        for i, x in enumerate(nodes):
            score += sum(model.word[f][labels[i]] for f in features[i] if f in model.word)
            if i:
                score += float(model.pair[labels[x.parent], labels[i]])
        total += np.exp(score)
        on += np.exp(score) * np.array(labels)
    assert np.allclose(model.marginals(nodes), on / total)


def test_held_out_accuracy():
    model, right, count = hx.trained(), 0, 0
    for page, labels in hx.labelled_pages(120, seed=99):
        said = [p > 0.5 for _, p in hx.blocks_of(page, model)]
        assert len(said) == len(labels)
        right += sum(a == b for a, b in zip(said, labels, strict=True))
        count += len(labels)
    assert right / count > 0.95


def texts_of(page):
    return [t for t, p in hx.blocks_of(page, hx.trained()) if p > 0.5]


def test_stray_quotes_in_tags():
    page = "<body><article><p title='it's'>First paragraph with some words in it.</p><p>Second paragraph, it doesn't go.</p></article></body>"
    assert texts_of(page) == ["First paragraph with some words in it.", "Second paragraph, it doesn't go."]
    assert texts_of('<article><p class="a>b" data-x=\'>\'>One paragraph that is kept.</p></article>') == ["One paragraph that is kept."]


def test_linked_content_stays_and_buttons_go():
    page = """<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><article><h1>A title of some words</h1>
    <p>First paragraph of the text, long enough to be read as text.</p><p><a href="/r">See the related article about this</a></p>
    <ul><li><a href="/l">a linked reference</a></li><li>a plain one.</li></ul><button>Share this</button><p>Last paragraph of the text, it ends here.</p></article></body>"""
    assert texts_of(page) == ["A title of some words", "First paragraph of the text, long enough to be read as text.", "See the related article about this", "a linked reference", "a plain one.", "Last paragraph of the text, it ends here."]


def test_deep_pages_take_time_in_proportion():
    deep = "".join(f"<div class='n{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676 % 26)}'>" for k in range(50_000))
    began = time.time()
    nodes = hx.tree_of(f"{deep}<p>{'word ' * 40}.</p>" + "<p>x</p></b></p>" * 5000)
    assert len(nodes) > 50_000 and len(hx.trained().marginals(nodes)) == len(nodes)
    assert time.time() - began < 30


def test_heads_and_bodies_may_be_left_out():
    text = "A paragraph of the article, long enough to be read as text."
    for page in (
        f"<html><head><title>x</title><meta charset=utf-8><article><h1>A title of some words</h1><p>{text}</p></article>",
        f"<head><title>x</title><script>var a = 1;</script><link rel=a><style>p{{}}</style></head><article><h1>A title of some words</h1><p>{text}</p></article>",
        f"<title>x</title><body><article><h1>A title of some words</h1><p>{text}</p></article>",
        f"<html><head><article><h1>A title of some words</h1><p>{text}</p></article></html>",
    ):
        assert texts_of(page) == ["A title of some words", text]


def test_formulas_and_objects_stay_in_their_blocks():
    page = "<article><p>The area is <math><mrow><mi>a</mi><mo>=</mo><mi>b</mi></mrow></math> as all of us know well.</p><p>What is in <object data='x'>an object</object> stays here, too.</p></article>"
    assert texts_of(page) == ["The area is a=b as all of us know well.", "What is in an object stays here, too."]


def test_pages_without_elements_are_all_text():
    line = "word " * 400
    assert texts_of(line) == [line.strip()]
    assert texts_of("one &amp; two") == ["one & two"]
