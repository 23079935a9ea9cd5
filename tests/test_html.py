import random
import time

from pyspark.sql import functions as F

from checks import views as V
from pagewright.operators import extract

ODD = {
    "unclosed": "<title>T</title><body>seen<nav>gone<p>gone too</body>",
    "nested": "<aside>a<aside>b</aside>c</aside>kept",
    "crossed": "<nav><header></nav>x</header>y",
    "attribute": '<p title="a>b">text</p><a title="<x>" href="/q">l</a>',
    "entities": "<p>caf&eacute; &#8364; AT&T &amp;copy; &nbsp;end</p>",
    "no title": "<p>plain</p>",
    "empty title": "<title></title><p>x</p>",
    "comment": "<!-- <script> --><p>shown</p><script>var a = '</nav>';</script><a href='/x'>y</a>",
    "comment links": "<!-- <a href='/hidden'> --><a href=/bare>b</a><a name=x>no</a>",
    "stray": "1 < 2 and 3 > 2 <p>ok",
    "lines": "<p>one</p>\n\n  <p>two</p>\r\n three ",
    "template": "<template><p>not text</p></template>yes",
    "bare href": "<a href>self</a><a data-href='/no'>n</a>",
    "custom": "<header-like>kept</header-like><header>gone</header>",
    "upper": "<TITLE>Up &amp; Down</TITLE><NAV>n</NAV><A HREF='/Z'>z</A>",
    "closed from outside": "<ul><li><nav>m</li></ul>body text</nav>",
    "closed by div": "<div><nav></div>inside</nav><p>end</p>",
    "reopened": "<ol><li><aside>a</li>b<li>c</aside>d</li></ol>e",
    "self-closing": "<nav/>text<nav>gone</nav>after",
    "open inside": "<nav><ul><li>a<li>b<br></ul></nav>kept",
    "slash": "<a/href='/x'>l</a><a class='k'/href='/y'>m</a>",
    "glued": "<a href='/x'href='/y'>l</a><a id=\"i\"href=\"/z\">m</a>",
    "odd values": "<a href==/x>l</a><a href=>m</a><a href=a\"b>n</a>",
    "null": None,
}
FERRY = """<html><head><title>Ferry times</title><style>p { margin: 0 }</style></head>
<body><header>Harbour office</header><nav>All lines</nav><section><h2>Summer</h2>
<p>Boats leave every hour.</p></section><footer>Pier 4</footer><script>track("ferry")</script></body></html>"""


def pages(spark, html):
    rows = [(i, f"https://example.com/{i}", h) for i, h in enumerate(html)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def records(df, parser):
    rows = extract.extract_text(df, parser).orderBy("page_id").collect()
    return [(r.title, r.content, list(r.hrefs)) for r in rows]


def test_boilerplate_goes_and_text_stays(spark):
    for parser in extract.PARSERS:
        [(title, content, _)] = records(pages(spark, [FERRY]), parser)
        assert title == "Ferry times"
        assert content.split() == "Ferry times Summer Boats leave every hour.".split()


def test_auto_reads_odd_pages_like_the_parser(spark):
    df = pages(spark, [h for h in ODD.values() if h is not None])
    assert records(df, "auto") == records(df, "strict")


def test_auto_reads_malformed_pages_like_the_parser(spark):
    rng = random.Random(5)
    parts = ["<nav>", "</nav>", "<header id=h>", "</header>", "<div>", "</div>", "<ul><li>", "</li></ul>", "<p>", "</p>",
             "<a href='/a'>", "<a/href='/b'>", "<a href='/c'href='/d'>", "</a>", "<script>", "</script>", "<title>", "</title>",
             "<!--", "-->", "<br>", "<aside/>", " one ", "two", "\n", "&amp;"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(3, 12))) for _ in range(1500)]
    df = pages(spark, made)
    auto, strict = records(df, "auto"), records(df, "strict")
    assert [m for m, a, s in zip(made, auto, strict) if a != s] == []


def test_unclosed_scripts_take_linear_time(spark):
    df = pages(spark, ["<p>seen</p>" + "<script>x" * 110_000, "<nav>x" * 170_000 + "<p>y"]).cache()
    assert df.count() == 2
    records(pages(spark, ["<script>"]), "auto")
    start = time.monotonic()
    assert [r[1] for r in records(df, "auto")] == ["seen", ""]
    assert time.monotonic() - start < 20


def test_failure_defaults(spark):
    df = pages(spark, [None, "", "<p>x</p>"])
    assert records(df, "auto") == [("No Title", "", []), ("No Title", "", []), ("No Title", "x", [])]
    assert records(df, "native") == records(df, "auto")


def test_all_parsers_agree_on_the_page_table(spark):
    df = V.table(spark, "/root/testdata/sf0.01", "pages")
    native = records(df, "native")
    assert native == records(df, "strict")
    assert native == records(df, "auto")


def test_nearly_all_pages_stay_native(spark):
    marked = extract.with_markup(V.table(spark, "/root/testdata/sf0.01", "pages"))
    from pagewright.functions.html import is_plain_html

    plain = is_plain_html(F.col("markup"), F.col("body"))
    assert marked.where(~plain).count() == 0


def test_links(spark):
    html = """<p><a href="../crete">c</a> <a href="https://isles.example/malta">m</a> <a>none</a>
    <a href="tel:+35600">call</a> <a href="/samos">s</a> <a href="https://elsewhere.example/x">x</a>
    <a href="/samos#port">again</a></p>"""
    df = pages(spark, [html]).withColumn("url", F.lit("https://isles.example/list/"))
    from pagewright.functions.urls import in_allowed_domains

    allowed = in_allowed_domains("link", ["isles.example"])
    rows = extract.page_outlinks(extract.extract_text(df), allowed).orderBy("pos").collect()
    assert [r.link for r in rows] == [f"https://isles.example/{name}" for name in ("crete", "malta", "samos")]


def test_status_filter(spark):
    df = pages(spark, ["<p>a</p>", "<p>b</p>"]).withColumn(
        "status_code", F.when(F.col("page_id") == 0, 200).otherwise(404)
    )
    assert [r.page_id for r in extract.page_records(df).collect()] == [0]
