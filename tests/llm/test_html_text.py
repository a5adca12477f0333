import html
import re
import time

import numpy as np
import pytest

from plansight.llm import html_layouts as hl
from plansight.llm import html_text as ht
from plansight.llm.queries import QUERIES

from ..conftest import SMALL


@pytest.fixture(scope="module")
def tree(spark):
    return ht.train(spark, *ht.labelled())


def main(tree, page):
    (blocks, _, hit), = ht.classified(tree, [page])
    return [b.text for b, m in zip(blocks, hit, strict=True) if m]


def test_given_pages_equal_their_articles(spark):
    """The given pages name their article, so a plainer reading of it is the truth."""
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = QUERIES["op13_html_text"](spark, SMALL).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", p))).split()) for p in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n\n".join(p for p in parts if p)
        assert r["n_chars"] == len(r["text"]) and r["url"] == pages[r["page_id"]]["url"]


def test_accuracy_on_unseen_pages_and_layouts(spark, tree):
    x, y = ht.labelled(seed=99, copies=30)
    assert (tree.predict(x) == y).mean() > 0.98
    seen, unseen = [l for i, l in enumerate(hl.LAYOUTS) if i % 3], hl.LAYOUTS[::3]
    other = ht.train(spark, *ht.labelled(layouts=seen))
    x, y = ht.labelled(seed=4, layouts=unseen)
    assert (other.predict(x) == y).mean() > 0.95


def test_whole_pages(tree):
    long = " ".join(["word"] * 30) + "."
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style></head><body class="has-sidebar">
      <div class="CookieNotice"><p>{long}</p></div><header class="site-header"><h1>Site</h1></header><nav><a href=/>Home</a></nav>
      <main><article><header class="page-header"><h1>The&nbsp;Title</h1></header>
      <p>First <b>bo</b>ld &lt;tag&gt;<br>and   <a href="/x">link</a> {long}</p><script>if (a < b) document.write("<p>no</p>")</script>
      <noscript>Enable it</noscript><div class="ad-slot">Buy</div><aside>Aside {long}</aside>
      <p>Short.</p><form><label>Mail</label><p>{long}</p><button>Send</button></form>
      <!-- <p>no</p> --><ul><li>One<li>Two {long}</ul></article>
      <section id="comments"><h2>Comments</h2><article class="comment"><p>Reader {long}</p></article></section></main>
      <div class="sidebar"><p>Side {long}</p></div><footer><p>&copy; {long}</p></footer></body></html>"""
    assert main(tree, page) == ["The Title", f"First bold <tag> and link {long}", "Short.", "One", f"Two {long}"]


def test_a_form_around_the_page_is_the_page(tree):
    long = " ".join(["word"] * 40) + "."
    page = f"<form id=f><div><a href=/1>a b</a> <a href=/2>c</a></div><div><h1>Title here</h1><p>{long}</p><p>{long}</p><p>{long}</p></div></form>"
    assert main(tree, page) == ["Title here", long, long, long]


def test_reading_follows_browsers():
    def texts(page):
        return [b.text for b in ht.blocks_of(page)]

    assert texts(None) == [] and texts("") == [] and texts(" <p> &nbsp; </p>") == []
    assert texts("a < b <3 c<p>d") == ["a < b <3 c", "d"]
    assert texts("x<!-- <p>y") == ["x"] and texts("x<script>y<p>z") == ["x"] and texts("x<SCRIPT>y</Script>z") == ["xz"]
    assert texts("x<p title='a>b'>y</p ><div") == ["x", "y"]
    assert texts("x<p title='never closed>y<p>z") == ["x", "y", "z"]
    assert texts("&am<b>p;</b> &amp;lt; &#65; &unknown; &copy") == ["&amp; &lt; A &unknown; ©"]
    assert texts("<table><tr><td>a<td>b</table>c") == ["a", "b", "c"]
    assert texts("a<br>b<wbr>c<br/>d") == ["a bc d"]
    links = ht.blocks_of("<div><a href=x>one two</div><p>three <a>four</a></p>")
    assert [(b.words, b.linked) for b in links] == [(2, 2), (2, 1)]


@pytest.mark.parametrize("bad", ["<a b=\"", "<a b='", "<", "<!--", "</", "<div>", "</div>", "&", "<p class='x' ", "<script", "<li>", "<a"])
def test_reading_is_linear(bad):
    start = time.perf_counter()
    ht.blocks_of(bad * (600_000 // len(bad)))
    assert time.perf_counter() - start < 20


def test_edges(spark, tree):
    rows = [(1, "u", None), (2, None, ""), (None, "v", "<article><p>kept</p></article>"), (3, "w", "<nav>menu</nav>"),
            (3, "w", "<nav>menu</nav>"), (4, "l", "<article><p>" + "long " * 300_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS words")
    got = sorted((tuple(r) for r in ht.report(df).collect()), key=repr)
    assert [(p, u, n) for p, u, _, n in got] == [(1, "u", 0), (2, None, 0), (3, "w", 0), (3, "w", 0), (4, "l", 1_499_999), (None, "v", 4)]
    assert ht.report(df.limit(0)).count() == 0
    whole = ht.with_main_text(df, tree=tree)
    assert whole.columns == ["page_id", "url", "html", "text", "words", "_text"] and whole.where("_text = 'kept' AND text = 't'").count() == 1
    blocks = ht.text_blocks(df, tree)
    assert blocks.where("page_id = 3").count() == 2 and blocks.where("main AND page_id IS NULL").first()["text"] == "kept"


def test_labels_are_spread():
    x, y = ht.labelled()
    assert x.shape == (len(y), len(ht.FIELDS)) and 0.3 < y.mean() < 0.7 and np.isfinite(x).all()
