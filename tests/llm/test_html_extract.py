"""Page text: the block reader on odd markup, the network's gradients, and whole pages."""

import re
from html import unescape

import numpy as np
import pytest

from caretlake.llm.common import table
from caretlake.llm.html_blocks import blocks_of
from caretlake.llm.html_extract import Labeller, extract_text, features_of, train_labeller
from caretlake.llm.page_samples import made_up
from tests.conftest import SF


def texts(html):
    return [b.text for b in blocks_of(html)]


@pytest.mark.parametrize("html, want", [
    ("", []), ("  \n ", []), ("plain  text", ["plain text"]), ("a<b>c</b>d<p>e<br>f", ["acd", "e", "f"]),
    ("<p>one<p>two</p>three", ["one", "two", "three"]), ("5 < 6 &amp; 7 &lt; 8 &am", ["5 < 6 & 7 < 8 &am"]),
    ('<script>var t="</p>";x</script><p>y</p>', ["y"]), ("<script>never closed <p>x", []),
    ("<!-- <p>no</p> --><p title='a>b'>yes</p>", ["yes"]), ('<p title="open>text', ["text"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]), ("</p></div>x</>y", ["xy"]),
    ("<P CLASS=x>a&nbsp;&#32;b </P>", ["a b"]), ("<textarea>t</textarea><style>s</style>u", ["t", "u"]),
    ("<p>a <noscript>b</noscript> c", ["a", "c"]), ("<div" * 3 + ">x", ["x"])])
def test_blocks(html, want):
    assert texts(html) == want


def test_links_and_paths():
    menu, body = blocks_of('<nav class="topNav"><a href=x>go now</a> on</nav><article><p>t</p></article>')
    assert menu.linked == 6 and body.linked == 0 and not menu.path & body.path
    assert blocks_of('<div class="topNav">x')[0].path & menu.path
    inner = blocks_of("<p><a>x<p>y</p>")
    assert [b.linked for b in inner] == [1, 0]


def test_deep_and_long_pages_are_read_whole():
    assert texts("<div>" * 100_000 + "x" + "</div>" * 100_000) == ["x"]
    assert texts("<a <" * 20_000) is not None
    assert len(blocks_of("<p>word" * 50_000)) == 50_000


def test_gradients():
    pages = made_up(3, seed=1)
    net = Labeller(seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    some, labels = [features_of(b) for b, _ in pages], [np.array(y, float) for _, y in pages]
    _, grad = net.gradients(some, labels)
    rng = np.random.default_rng(0)
    for name, w in net.w.items():
        at = tuple(int(rng.integers(n)) for n in w.shape) if name not in ("path", "word") else \
            (int(some[0].path[0] if name == "path" else some[0].word[0]), 1)
        kept, step = w[at], 1e-2
        w[at] = kept + step
        up, _ = net.gradients(some, labels)
        w[at] = kept - step
        down, _ = net.gradients(some, labels)
        w[at] = kept
        assert grad[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-4, rel=0.02), name


@pytest.fixture(scope="module")
def model(llm):
    return train_labeller(table(llm, SF, "pages"))


def brute(html):
    inside = re.search(r"<article>(.*?)</article>", html, re.DOTALL)[1]
    return " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inside))).split())


def test_query_table(llm, model):
    pages = table(llm, SF, "pages")
    want = {r.page_id: (r.url, brute(r.html)) for r in pages.collect()}
    got = extract_text(pages, model).collect()
    assert len(got) == len(want)
    wrong = [r.page_id for r in got if (r.url, r.text) != want[r.page_id]]
    assert len(wrong) <= len(got) * 0.002
    assert all(r.n_chars == len(r.text) for r in got)


def test_held_out_layouts(model):
    pages = made_up(200, seed=12345)
    found = model.is_article([b for b, _ in pages])
    wrong = sum(int((np.array(y, bool) != got).sum()) for (_, y), got in zip(pages, found))
    assert wrong <= 0.01 * sum(len(y) for _, y in pages)


PROSE = ["The committee met on Tuesday to discuss the plans for the harbour, which had been put off twice.",
         "Nobody expected the vote to be close, yet three members changed their minds in the last hour.",
         "Work on the new pier begins in spring and is to last two years, the council said."]


@pytest.mark.parametrize("page", [
    '<body><div class="navbar"><a href=/>Home</a> <a href=/n>News</a></div><div class="post-content"><h1>{h}</h1>'
    '<p>{0}</p><div class="advert">Buy cheap boats now</div><p>{1}</p><p>{2}</p></div>'
    '<div id="comments"><h3>Comments</h3><div class="comment"><p>I never liked that pier at all.</p></div></div>'
    '<div class="footer">Copyright 2020 The Harbour</div></body>',
    '<html><head><title>{h} - Harbour</title></head><body><header><h1>The Harbour</h1></header><main><article><h2>{h}</h2><p>{0}'
    '<p>{1}<p>{2}</article><aside class="related"><h3>Related</h3><ul><li><a href=/x>Other news today</a></li></ul></aside>'
    '</main><div class="cookie-notice">We use cookies. <button>Accept</button></div>'
    '<form class="newsletter"><label>Email</label><input><button>Subscribe</button></form>'
    '<footer><p>All rights reserved</p></footer></body></html>'])
def test_other_layouts(llm, model, page):
    html = page.format(*PROSE, h="Harbour vote")
    df = llm.createDataFrame([(1, "u", html)], "page_id int, url string, html string")
    assert extract_text(df, model).first().text == " ".join(["Harbour vote", *PROSE])


def test_hard_rows(llm, model):
    rows = [(1, "u", None, "c"), (1, "u", "", "c"), (None, None, "<p>", "c"), (2, "v", "<" * 5000, "c"),
            (2, "v", "<article><p>" + "word " * 200_000 + "</p></article>", "c"), (3, "w", "&#0;&#xD800;&#99999999;", "c")]
    df = llm.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = extract_text(df, model).collect()
    assert len(got) == 6 and got[0].text == "" and got[0].n_chars == 0
    assert max(r.n_chars for r in got) == 200_000 * 5 - 1
    assert extract_text(df.limit(0), model).columns == ["page_id", "url", "text", "n_chars"]
    assert train_labeller(df.limit(0), made_pages=2, epochs=1).is_article([[], []])[1].tolist() == []
