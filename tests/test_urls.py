from urllib.parse import urljoin, urlparse

from pyspark.sql import functions as F

from pagewright.functions import urls
from pagewright.functions.html_strict import join_urls
from pagewright.operators.links import filter_allowed

BASES = [
    "http://h.com", "http://h.com/", "http://h.com/a/b", "https://H.com/a/b/?q=1#f",
    "http://h.com/a/b/c;p?x=y", "http://h.com?z=1", "https://u@h.com:80/dir/",
]
REFERENCES = [
    "", "#x", "?q=2", "?", "a", "./a", "../a", "../../../a", "/a/../b", "/a/./b/.", "/..",
    "/a/b/..", "//o.com/x/../y", "http://o.com/../x", "https://o.com", "HTTP://O.com/P",
    "mailto:x@y", "x;p=1?z", "/x;p/y;q?z#f", "a//b", "/a//b", "..", ".", " /sp ace ",
    "javascript:void(0)", "a/../..", "/no.", "/.hidden", "x:y", "http:rel", "dir/", "/", "//",
    "a?b=/../c", "?a=/./b", "page.html#top", "é/ü",
]


def expected_link(base, href):
    p = urlparse(urljoin(base, href.lstrip(" ")))
    if not p.netloc or p.scheme not in ("http", "https"):
        return None
    return f"{p.scheme}://{p.netloc}{p.path}" + (f"?{p.query}" if p.query else "")


def test_resolution_equals_the_standard_library(spark):
    rows = [(b, r) for b in BASES for r in REFERENCES]
    df = spark.createDataFrame(rows, "b string, r string")
    native = urls.resolve_url("b", "r")
    strict = urls.canonical_url(join_urls("b", "r"))
    got = df.select(
        "b", "r",
        F.when(urls.is_web_url(native), native).alias("native"),
        F.when(urls.is_web_url(strict), strict).alias("strict"),
    ).collect()
    wrong = [r for r in got if r.native != expected_link(r.b, r.r)]
    assert not wrong
    assert not [r for r in got if r.strict != expected_link(r.b, r.r)]


def test_validity_and_domains(spark):
    rows = [
        ("https://example.com", True, "example.com"),
        ("https://www.example.com", True, "example.com"),
        ("https://sub.example.com", True, "sub.example.com"),
        ("http://example.com/path", True, "example.com"),
        ("http://sub.example.com/path", True, "sub.example.com"),
        ("ftp://example.com", False, "example.com"),
        ("https://other.com", False, "other.com"),
        ("https://notexample.com", False, "notexample.com"),
        ("not-a-url", False, ""),
        ("", False, ""),
        ("HTTP://WWW.Example.com:8080/x", False, "example.com:8080"),
        ("http://[::1", False, "unknown"),
    ]
    df = spark.createDataFrame(rows, "url string, ok boolean, domain string")
    valid = urls.is_web_url("url") & urls.in_allowed_domains("url", ["WWW.Example.com"])
    for r in df.select("*", valid.alias("v"), urls.extract_domain("url").alias("d")).collect():
        assert (r.v, r.d) == (r.ok, r.domain), r.url
    table = spark.createDataFrame([("www.EXAMPLE.com",)], "domain string")
    kept = {r.url for r in filter_allowed(df.where(urls.is_web_url("url")), "url", table).collect()}
    assert kept == {u for u, ok, _ in rows if ok}


def test_display_domain(spark):
    rows = ["https://u:p@www.Shop.example.com:81/x", "https://a.www.b.com/", "nonsense", "http://x.org"]
    df = spark.createDataFrame([(r,) for r in rows], "url string")
    got = [r.d for r in df.select(urls.display_domain("url").alias("d")).collect()]
    assert got == ["shop.example.com", "a.b.com", "unknown", "x.org"]


def test_fill_domain(spark):
    df = spark.createDataFrame([("", "http://a.b"), (None, "http://a.b"), ("kept", "http://a.b")], "d string, u string")
    assert [r.x for r in df.select(urls.fill_domain("d", "u").alias("x")).collect()] == ["a.b", "a.b", "kept"]
