from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dayweave.llm import main_text

PARAGRAPH = "A paragraph, with some commas, that is long enough to be taken for the text of an article."
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t = "</p>, a, b, c";</script></head><body class="no-sidebar">
<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><div class="menu"><a href=1>One</a></div>
<div id="cookie-notice">We use cookies, many, many, many of them, all over this place.</div>
<div id="wrap"><div class="content"><h1>Title &amp; more</h1><p>{PARAGRAPH}</p><!-- <p>hidden</p> -->
<div class="advert">Buy, buy, buy now, very nice, very cheap, very new things here today</div>
<ul><li>one item</li><li>two <a href=x>items</a></li></ul><p>Second&nbsp;paragraph<br>
  is   here, too.</p><form>Name <input name=a></form></div>
<div class="sidebar">{PARAGRAPH}</div><section id="comments"><article class="comment"><p>{PARAGRAPH}</p></article></section></div>
<footer>Foot, &copy;</footer></body></html>"""


def test_page_parts():
    assert main_text.main_text(PAGE) == f"Title & more\n{PARAGRAPH}\none item\ntwo items\nSecond paragraph is here, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;text&gt;", "plain <text>"),
        ("<p>never closed", "never closed"),
        (f"<article><h1>T</h1><p><b>{PARAGRAPH}<br><p>next</p></article><footer>x</footer", f"T\n{PARAGRAPH}\nnext"),
        ("<article><header><h1>T</h1><p>By me</p></header><section><p>Aaa, bbb ccc ddd eee fff.</p></section><section><p>Bb</p></section></article>", "T\nAaa, bbb ccc ddd eee fff.\nBb"),
        ("<table><tr><td>a</td><td>b &amp</table>", "a\nb &"),
        ("<script>only</script><style>css</style>", ""),
        ("<div hidden>gone</div><p style='display: none'>gone</p><p>stays</p>", "stays"),
    ],
)
def test_pages(page, text):
    assert main_text.main_text(page) == text


def test_paragraphs_are_not_capped():
    body = "".join(f"<p>{PARAGRAPH} {i}</p>" for i in range(3000))
    assert main_text.main_text(f"<div class=menu><a>m</a></div><div>{body}</div>").count("\n") == 2999


def test_hostile_pages_end():
    for page in ("<div>" * 30_000 + "x", "<a " * 20_000, '<a b="' * 20_000, "<p>" + "a, " * 200_000, "</div>" * 20_000, "<" * 20_000):
        assert isinstance(main_text.main_text(page), str)


def test_column(spark):
    rows = spark.createDataFrame([(1, PAGE, "x"), (2, None, None), (2, None, "y")], "page_id long, html string, text string")
    found = [r.out for r in rows.select("page_id", main_text.extracted(F.col("html")).alias("out")).orderBy("page_id").collect()]
    assert found == [main_text.main_text(PAGE), "", ""]
    assert rows.limit(0).select(main_text.extracted(F.col("html"))).collect() == []


def test_given_pages(spark):
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", main_text.extracted(F.col("html")).alias("text")).collect()
    for r in rows:
        inner = r.html[r.html.index("<article>") + 9 :]
        inner = inner.split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)


LONG = "This paragraph is long enough to count, has commas, and says something of its own for a reader. " * 3


def test_parts_between_two_sections_of_a_plain_container_stay():
    page = f"""<body><div id=x><h2>Title</h2><section><p>{LONG}</p><p>{LONG}</p></section><h3>Between</h3><p>Short one.</p><ul><li>first</li><li>second</li></ul>
    <section><p>{LONG}</p></section><p>The end.</p></div><div class=footer><p>Copyright of all of this is with someone else entirely.</p></div></body>"""
    long = LONG.strip()
    assert main_text.main_text(page).split("\n") == ["Title", long, long, "Between", "Short one.", "first", "second", long, "The end."]


def test_a_short_second_article_stays():
    page = f"<body><main><article><h1>One</h1><p>{LONG}</p><p>{LONG}</p></article><article><h2>Two</h2><p>Only a line.</p></article></main><aside>Side</aside></body>"
    assert main_text.main_text(page).split("\n") == ["One", LONG.strip(), LONG.strip(), "Two", "Only a line."]


def test_a_list_of_links_in_an_article_stays_unless_marked():
    links = "".join(f"<li><a href=#{n}>Source number {n}</a></li>" for n in range(3))
    page = f"<body><ul>{links}</ul><article><p>{LONG}</p><ul>{links}</ul><ul class=menu>{links}</ul><p>{LONG}</p></article></body>"
    assert main_text.main_text(page).split("\n") == [LONG.strip(), "Source number 0", "Source number 1", "Source number 2", LONG.strip()]


def test_a_list_of_links_outside_an_article_goes():
    links = "".join(f"<li><a href=#{n}>Source number {n}</a></li>" for n in range(4))
    page = f"<body><div><ul>{links}</ul><p>{LONG}</p><p>{LONG}</p></div></body>"
    assert main_text.main_text(page).split("\n") == [LONG.strip(), LONG.strip()]
