"""Blocks and main text of pages: known pages, other templates, odd html, gradients and held-out pages."""

import numpy as np
import pytest

from tessera.llm import html_extract as m
from tessera.llm.block_pages import made_page


def texts(page):
    return [b.text for b in m.Parser(page).blocks]


@pytest.mark.parametrize("page, want", [
    ("", []),
    ("plain text", ["plain text"]),
    ("a &lt; b &amp;amp; c&nbsp;&eacute; &copy 1", ["a < b &amp; c é © 1"]),
    ("<p>one<p>two<br>three<div>four</p>five", ["one", "two three", "four", "five"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
    ("<table><tr><td>a<td>b<tr><th>c</table>d", ["a", "b", "c", "d"]),
    ("<p>x<script>var t='</p><p>no';</script>y</p><style>p{}</style><!-- <p>no</p> --><noscript>no</noscript>z", ["x", "y", "z"]),
    ("<script>never closed <p>no</p>", []),
    ("a <!-- never closed", ["a"]),
    ("1 < 2 and 3 <4> 5 < b", ["1 < 2 and 3 <4> 5 < b"]),
    ("<p title='a>b' class=\"x\">in</p><a href=\"x>y\">l</a> t", ["in", "l t"]),
    ("<p>t <a href=\"broken>link</a> rest<p>more", ["t link rest", "more"]),
    ("<P>A  \n\t B</P >C", ["A B", "C"]),
    ("<head><title>no</title><meta x></head><body>yes", ["yes"]),
    ("<div>a<b>b<i>c</div>d</i></b></div></p>e", ["abc", "d", "e"]),
    ("<?xml ?><!DOCTYPE html><x-y>a</x-y><![CDATA[b]]>", ["a"]),
])
def test_blocks(page, want):
    assert texts(page) == want


def test_made_pages_are_read_as_they_were_made():
    for seed in range(200):
        page, blocks = made_page(seed)
        assert texts(page) == [" ".join(t.split()) for t, _ in blocks]


def test_long_and_deep_pages_are_linear():
    assert len(texts("<div>" * 50_000 + "x" + "</div>" * 50_000 + "<p>y" * 50_000)) == 50_001
    assert len(texts("<a \"><a ' " * 30_000 + "> <p>t")) <= 1
    assert texts("<b>" * 30_000 + "</i>" * 30_000 + "t") == ["t"]


def test_gradient_equals_differences(monkeypatch):
    rng = np.random.default_rng(1)
    w = {k: v.astype(np.float64) for k, v in m.new_weights(rng).items()}
    x = rng.standard_normal((5, 3, m.PATH_DIM + m.WORD_DIM + m.FIGURES))
    mask = np.ones((5, 3, 1))
    mask[3:, 1] = mask[1:, 2] = 0
    into = rng.standard_normal((5, 3, m.UNITS))
    for d in "fb":
        tape: list = []
        monkeypatch.setattr(m.np, "float32", np.float64)
        m.read(w, x, mask, d, tape)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        dx = m.way_back(w, x, mask, d, tape, into * mask, grad)
        loss = lambda d=d: float((m.read(w, x, mask, d) * into * mask).sum())
        for name, at in ((f"x{d}", (2, 5)), (f"h{d}", (1, 30)), (f"b{d}", (40,))):
            w[name][at] += 1e-5
            up = loss()
            w[name][at] -= 2e-5
            down = loss()
            w[name][at] += 1e-5
            assert grad[name][at] == pytest.approx((up - down) / 2e-5, rel=1e-4, abs=1e-6)
        x[1, 1, 4] += 1e-5
        up = loss()
        x[1, 1, 4] -= 2e-5
        assert dx[1, 1, 4] == pytest.approx((up - loss()) / 2e-5, rel=1e-4, abs=1e-6)
        monkeypatch.undo()


def test_held_out_pages():
    right = wrong = missed = 0
    pages = [made_page(10**9 + k) for k in range(150)]
    for found, (_, blocks) in zip(m.labelled([p for p, _ in pages], m.trained()), pages, strict=True):
        for (b, s), (_, y) in zip(found, blocks, strict=True):
            right += len(b.text) * (s >= 0.5 and y)
            wrong += len(b.text) * (s >= 0.5 and not y)
            missed += len(b.text) * (s < 0.5 and y)
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_scores_do_not_depend_on_the_other_pages():
    w = m.trained()
    pages = [made_page(5_000 + k)[0] for k in range(30)] + ["", None, "<p>x"]
    alone = [[s for _, s in next(iter(m.labelled([p], w)))] for p in pages]
    for found, want in zip(m.labelled(pages, w), alone, strict=True):
        assert np.allclose([s for _, s in found], want, atol=1e-5)


ARTICLE = "<h1>The river</h1>" + "".join(f"<p>It was a long way down to the water, and {w} went first. Nobody said a word about the boat.</p>" for w in ("she", "he", "the dog", "the child"))
PAGES = {
    "article": f"<html><body><nav><ul><li><a href=/>Home</a><li><a href=/n>News</a></ul></nav><div class=ad>Buy now!</div><article>{ARTICLE}</article><footer>&copy; 2020 Site. All rights reserved.</footer>",
    "divs": f"<body><div id=header><a href=/>My site</a></div><div class='cookie-notice'>We use cookies.</div><div class='post-content'>{ARTICLE}</div><div class=sidebar><h3>Most read</h3><ul><li><a href=a>One thing</a><li><a href=b>Other thing</a></ul></div><div class=comments><h2>2 comments</h2><div class=comment><p>Anna says:</p><p>I liked the part about the dog very much. It was good.</p></div><div class=comment><p>Bo says:</p><p>So did I, and the boat as well.</p></div></div><div id=footer><a href=p>Privacy</a> <a href=t>Terms</a></div>",
    "main": f"<body><header><a href=/>Logo</a></header><main>{ARTICLE}<form action=/s><p>Subscribe: <input name=q></p><button>Send</button></form></main><aside class=related><p><a href=x>Related: another river</a></p></aside><footer>Imprint</footer>",
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_other_sites(name):
    want = texts(ARTICLE)
    (found,) = m.labelled([PAGES[name]], m.trained())
    assert [b.text for b, s in found if s >= 0.5] == want


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "u1", PAGES["article"]), (2, "u2", None), (3, None, ""), (None, "u4", PAGES["article"]), (1, "u1", PAGES["article"]), (5, "u5", "<nav><a href=x>Home</a></nav>"), (6, "u6", "<article>" + ARTICLE * 2_000 + "</article>")]
    spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, text string, n_chars string").write.parquet(f"{tmp_path}/pages.parquet")
    got = m.op12_html_extract(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r.page_id, r.url): r for r in got.collect()}
    assert got.count() == len(rows) and found[1, "u1"].text == "\n".join(texts(ARTICLE)) == found[None, "u4"].text
    assert [found[k].text for k in ((2, "u2"), (3, None), (5, "u5"))] == ["", "", ""]
    assert found[6, "u6"].text.count("\n") > 2_000 * len(texts(ARTICLE)) - 10
    assert all(r.n_chars == len(r.text) for r in found.values())
    blocks = m.page_blocks(spark.read.parquet(f"{tmp_path}/pages.parquet")).where("page_id = 5").collect()
    assert [(b.block, b.tags, b.text) for b in blocks] == [(0, "nav", "Home")]
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/none/pages.parquet")
    assert m.op12_html_extract(spark, f"{tmp_path}/none").count() == 0
