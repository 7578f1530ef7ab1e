"""Blocks, tree and main text of pages, against the pages' own article element."""

import html
import random
import re
from pathlib import Path

import numpy as np
import pytest

from minekit.llm import html_text, queries

DATA = "/root/testdata/sf0.01"
LONG = "Some words of the story stand here and go on for a while, as a story does, until they end."
TREE = html_text.trained()


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_fits_its_table():
    table, labels = html_text.labelled()
    assert len(labels) > 200 and ((html_text.judged(TREE, table) > 0.5) == labels).mean() > 0.97


def test_tree_is_grown_by_the_best_split():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 5, (80, 3)).astype(float)
    labels = (table[:, 1] > 2) ^ (rng.random(80) < 0.1)
    best = []
    for f in range(3):
        for t in np.arange(0.5, 4):
            low = table[:, f] <= t
            if 2 <= low.sum() <= 78:
                best.append((sum(len(x) * x.mean() * (1 - x.mean()) for x in (labels[low], labels[~low])), f, t))
    assert html_text.grown(table, labels, depth=1)[:2] == min(best)[1:]


def test_query_gives_the_articles(spark):
    if not Path(DATA).exists():
        pytest.skip("test tables are not present")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op12_main_text(spark, DATA).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_regions_beside_the_text():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><meta charset=utf-8></head>
    <body class="has-sidebar comments-open"><header class=site><h1>Site</h1></header>
    <div id="cookie-notice">{LONG}</div><nav><ul><li><a href=/>Home</a></ul></nav>
    <main><article><header><h1>Title &amp; more</h1></header><p>{LONG}<p>Second <a href="a>b">para</a> &lt;x&gt;&nbsp; end<br>
    behind<aside><p>{LONG}</p></aside><form><label>Name</label><input><textarea>no</textarea></form><p>Short.</p>
    <script>if (a<b) document.write("<p>no</p>")</script><!-- <p>no</p> --><noscript>{LONG}</noscript>
    <div class="user comments"><p>{LONG}</p></div></article></main><div class=sidebar><p>{LONG}</p></div>
    <p class="ad">{LONG}</p><div role=banner>{LONG}</div><footer>c</footer></body></html>"""
    assert text(page) == ["Title & more", LONG, "Second para <x> end behind", "Short."]


def test_pages_without_a_main_element():
    menu = "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(6))
    page = f"<ul>{menu}</ul><h1>The title stands here</h1><p>{LONG} {LONG}</p><div>{LONG} {LONG}</div><p>{LONG}</p><ul>{menu}</ul>"
    assert text(page) == ["The title stands here", f"{LONG} {LONG}", f"{LONG} {LONG}", LONG]


@pytest.mark.parametrize(
    "page, expected",
    [
        ("", []),
        ("   \n ", []),
        ("<", []),
        ("<article><p>a < b and c > d &unknown; &#228;&#x41;&eacute", ["a < b and c > d &unknown; äAé"]),
        ('<article><p>left <a href="open>link</p><p>next</p></article>', ["left link", "next"]),
        ("<article><p>x</p></article></div></nav></p><nav><a>y</a></nav>", ["x"]),
        ("<article><p>x<!-- never closed <p>y</p>", ["x"]),
        ("<article><p>x<script>never closed <p>y</p>", ["x"]),
        ("<article><p>x <b>bold<p>y</b> z</article><p>out", ["x bold", "y z"]),
        ("<ARTICLE><P>UP</P></ARTICLE>", ["UP"]),
        ("<article><table><tr><td>a<td>b</table><ul><li>c<li>d</ul><pre>e\n  f</pre></article>", ["a", "b", "c", "d", "e f"]),
        ("<article><div hidden>no</div><p style='display: none'>no</p>yes</article>", ["yes"]),
        ("<title>only", []),
        ("<article><p>cut <b", ["cut"]),
    ],
)
def test_broken_pages(page, expected):
    assert text(page) == expected


def test_any_markup_ends():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<b>", "</div>", "<div class='ad'>", "<!--", "-->", "<script>", "</script>", "<", ">", "&amp", '"', "'", "a b", "<a href='", "<article>"]
    for _ in range(300):
        text("".join(rng.choices(parts, k=rng.randrange(60))))
    for part in ("<b>", "<p", "<a \"", "&amp;", "<div>", "</div>", "<!--", "x <"):
        text(part * 50_000)


def test_rows(spark):
    data = [
        (1, "u", f"<article><p>{LONG}</p></article>", "k", "k"), (2, None, None, None, None), (3, "v", "", "k", "k"),
        (None, "w", "<article>x</article>", "k", "k"), (1, "u", f"<article><p>{LONG}</p></article>", "k", "k"),
        (4, "big", "<article>" + f"<p>{LONG}</p>" * 60_000 + "</article>", "k", "k"),
    ]
    schema = "page_id long, url string, html string, text string, n_blocks string"
    got = html_text.extract(spark.createDataFrame(data, schema).repartition(3))
    assert got.columns == ["page_id", "url", "text", "n_blocks", "n_main"]
    rows = sorted(((r.page_id, r.url, r.text, r.n_blocks) for r in got.collect()), key=repr)
    expected = [(1, "u", LONG, 1), (2, None, "", 0), (3, "v", "", 0), (None, "w", "x", 1), (1, "u", LONG, 1)]
    assert rows == sorted([*expected, (4, "big", "\n".join([LONG] * 60_000), 60_000)], key=repr)
    assert html_text.extract(spark.createDataFrame([], schema)).collect() == []
