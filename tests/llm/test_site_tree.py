"""Main texts of pages: planted pages of every kind of noise, site by site."""

import html
import math
import re
import time

import duckdb
import pytest
from oracle import SMALL

from dossierlake.llm import html_pages, registry, site_tree


def text(source, url="http://one.example/a"):
    return html_pages.text_of(html_pages.chosen(html_pages.read(source, html_pages.site_of(url))), set())


def test_query_against_the_articles_of_the_pages(spark):
    rows = duckdb.sql(f"SELECT page_id, url, html FROM '{SMALL}/pages.parquet'").fetchall()
    got = {r.page_id: r for r in registry.QUERIES["op11_site_text"](spark, SMALL).collect()}
    assert len(got) == len(rows)
    for page, url, source in rows:
        body = re.search(r"<article>(.*)</article>", source, re.DOTALL)[1]
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"<(?!/?b>)[^>]+>", " ", body))).split())
        assert (got[page].url, got[page].text, got[page].n_chars) == (url, want, len(want))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text &amp; more", "just text & more"),
        ("<p>a&nbsp;&nbsp;b\n c<p>d<b>e</b>f<br>g", "a b c def g"),
        ("<title>t</title><style>p{}</style><script>var a='</p><p>x';</script><p>1 < 2 and <3</p>", "1 < 2 and <3"),
        ("<nav>n</nav><header>h</header><main><h1>T</h1><p>x</p></main><footer>f</footer>", "T x"),
        ("<article><header><h1>T</h1></header><p>x</p><aside>s</aside><form>f <p>g</p></form><p>y</p></article><div>out</div>", "T x y"),
        ('<div class="post-body">a</div><div id="comments"><p>b</p><div>c</div></div><div class="cookieNotice">d</div>e', "a e"),
        ('<div class="with-sidebar">a<div class="sidebar-left">b</div></div>', "a"),
        ('<article>x<article class="comment">no</article><section class="Comments">no<p>no</section>y</article>', "x y"),
        ('<div class="ads"><span>no</span></div><span class="ad">no</span><p>yes<span>!</span></p>', "yes!"),
        ("<!-- c --><p>a<!-- > --> b<!-->c</p><![CDATA[x]]><?php y ?>d", "a bc d"),
        ('<p title="a>b" hidden>no</p><p style="display: none">no</p><p aria-hidden=true>no</p><p>yes</p>', "yes"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a b c d e"),
        ("<p>&#8217;&eacute;&copy &lt;b&gt;</p><noscript>js</noscript><iframe>f</iframe>", "’é© <b>"),
        ('<div role="navigation">n</div><div role="main">m</div><div>o</div>', "m"),
        ("<p>a</p><!-- never closed <p>b</p>", "a"),
        ("<article></article><div>out</div>", ""),
        ('<div class="related"><article>only</article></div>', "only"),
        ("<p>x</p><script>never closed <p>b</p>", "x"),
        ('<article class="post category-advertising tag-cookies comments-open"><h1>T</h1><p>A <small class="ad">no</small>b<i>c</i></p></article>', "T A bc"),
        ('<article class="teaser">t</article><article>x</article>', "x"),
        ("<p>a<b>b<i class='ad'>no</i>c</b>d", "abcd"),
    ],
)
def test_one_page(source, want):
    assert text(source) == want


def planted():
    """Two sites without telling names: shared boxes, menus, and an article whose site repeats a paragraph."""
    soup = [
        f'<div class="a1"><a href="/">Home</a> <a href="/n">News</a></div><div class="b"><p>Story {i} of its own</p><p>More {i * i}</p></div>'
        f'<div class="c{i}">Made with love</div>'
        for i in range(12)
    ]
    shared = [
        f'<article><h1>T{i}</h1><p>All pages say this.</p><p>Own {i}</p><div class="x">Tell your friends</div></article>' for i in range(9)
    ]
    few = [f"<div>Shared</div><div><a>Link {i} and some more words</a></div><section>Own {i}</section>" for i in range(3)]
    same = ["<div>Only this</div>"] * 6
    rows, want = [], []
    for host, pages, of in (
        ("soup.example", soup, lambda i: f"Story {i} of its own More {i * i}"),
        ("shared.example", shared, lambda i: f"T{i} All pages say this. Own {i}"),
        ("few.example", few, lambda i: f"Shared Link {i} and some more words Own {i}"),
        ("same.example", same, lambda i: "Only this"),
    ):
        for i, page in enumerate(pages):
            rows.append((len(rows), f"https://u@{host}:8080/p{i}", page, i))
            want.append(of(i))
    return rows, want


@pytest.mark.parametrize("sent", [site_tree.SENT, 0])
def test_branches_of_a_site(spark, sent):
    rows, want = planted()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, __gone int")
    got = {r.page_id: r for r in site_tree.extract_text(frame, sent=sent).collect()}
    assert [got[k].text for k in range(len(rows))] == want
    assert [got[k]["__gone"] for k in range(len(rows))] == [r[3] for r in rows]


def test_importances_by_their_definition(spark):
    rows = [(f"http://h.example/{i}", f"<div class=a>same</div><div class=b>t{i // 2}</div>") for i in range(6)]
    frame = spark.createDataFrame(rows, "url string, html string")
    found = sorted((r.pages, round(r.content, 6), round(r.presentation, 6)) for r in site_tree.importances(site_tree.observations(frame)).collect())
    half = 1 - math.log(2) / math.log(6)
    assert found == sorted([(6, 0.0, 0.0), (6, round(half, 6), 0.0)])


def test_nulls_repeats_and_no_pages(spark):
    frame = spark.createDataFrame([(None, None, None), (1, "no url", "<p>a"), (1, "no url", "<p>a"), (2, None, "")], "page_id long, url string, html string")
    assert sorted(r.text for r in site_tree.extract_text(frame).collect()) == ["", "", "a", "a"]
    assert site_tree.extract_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("piece", ["<", "<div>", "<p>a", "<!--", "</div>", "<a '", '<a "', "<b>x", "<script>", "&amp", "<span class=ad>", "<li>", "<a =", "a" * 30])
def test_long_pages_take_time_by_their_length(piece):
    source = piece * (1_000_000 // len(piece))
    began = time.time()
    text(source)
    assert time.time() - began < 10
