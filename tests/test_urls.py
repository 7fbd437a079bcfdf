from __future__ import annotations

from urllib.parse import parse_qsl, quote_plus, urljoin, urlsplit, urlunparse, urlparse

import pytest
from pyspark.sql import functions as F

from clausedelta.functions import urls as ur

BASES = ["https://Town.gov/a/b/index.html?x=1", "http://town.gov", "https://town.gov/dir/", "https://town.gov/a/b/../c"]
HREFS = [
    "doc.pdf", "/doc.pdf", "../up.pdf", "./same", "../../../far", "sub/./x/../y", "?page=2", "#top", "//CDN.gov/z?utm_source=q&id=1",
    "HTTPS://Other.GOV/P?Q=a b&r=%7Ex*&s=%zz&t=a+b#f", "http://other.gov", "mailto:clerk@town.gov", "x?a=&b&c=1=2&&UTM_Medium=1",
    "y?q=%C3%A9&w=é", " spaced.pdf ", "a//b///c", "/a/..", "/a/.", "..", ".", "p;v=1", "https://o.gov/x?gclid=1", "view.aspx?ID=7&fbclid=q",
]


def expected(base, href):
    """The rule in terms of the standard library's URL functions."""
    href = href.strip()
    if not href:
        return ""
    if href.startswith("//"):
        href = (urlsplit(base).scheme or "https") + ":" + href
    u = urlparse(urljoin(base, href))
    pairs = [(k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if k.lower() not in ur.TRACKING_PARAMS]
    query = "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in pairs)
    return urlunparse((u.scheme if u.scheme in ("http", "https") else "https", u.netloc.lower(), u.path, u.params, query, ""))


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(b, h, expected(b, h), urljoin(b, h)) for b in BASES for h in [*HREFS, "", "  "]]
    return spark.createDataFrame(rows, "base string, href string, want string, joined string")


def test_normalize_equals_standard_library(pairs):
    out = ur.with_resolved_url(pairs, F.col("base"), F.col("href"), "url")
    wrong = [(r.base, r.href, r.url, r.want) for r in out.collect() if r.url != r.want]
    assert not wrong


def test_resolve_only(pairs):
    plain = pairs.where(~F.col("href").isin(" spaced.pdf ", "  "))
    out = ur.with_resolved_url(plain, F.col("base"), F.col("href"), "url", normalize=False)
    wrong = [(r.base, r.href, r.url, r.joined) for r in out.collect() if r.url != r.joined]
    assert not wrong


def check(spark, rows, column, schema="a string, b string"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("a"), F.col("b"))).collect()]


def test_classification_order(spark):
    rows = [
        ("Agenda of the zoning board", "u"), ("Amendment 4", "u"), ("Land-Use map", "u"), ("Zoning map", "u"), ("Map", "https://ecode360.com/1"),
        ("Map", "https://x.gov/map"), ("Golden rules", "u"),
    ]
    assert check(spark, rows, ur.classify_document) == [
        "meeting_minutes", "ordinance", "bylaw", "zoning_code", "zoning_code", "notice", "ordinance",
    ]
    assert check(spark, [("MINUTES ordinance", "u"), ("x", "/Ordinance"), ("x", "y")], ur.classify_basic) == [
        "meeting_minutes", "ordinance", "notice",
    ]


def test_pdf_host_and_safety(spark):
    rows = [("https://a.gov/x.PDF?q=1", "text/html"), ("https://a.gov/View.ashx?ID=1", None), ("https://a.gov/x", "Application/PDF; a"), ("https://a.gov/pdf/x", "")]
    assert check(spark, rows, ur.is_pdf) == [True, True, True, False]
    hosts = [("https://www.facebook.com/a", ""), ("https://fedex.com/", ""), ("https://a.gov/facebook.com", ""), ("https://User@X.COM:1/", "")]
    assert check(spark, hosts, lambda a, _: ur.is_allowed_host(a)) == [False, False, True, False]
    urls = [("http://127.0.0.1/a", ""), ("file:///etc/passwd", ""), ("ftp://a.b", ""), ("http://LOCALHOST:80/x", ""), ("https://10.1.1.1", ""),
            ("https://110.1.1.1", ""), ("https://u@192.168.0.1:8/", ""), ("https://a.gov/10.0.0.1", "")]
    assert check(spark, urls, lambda a, _: ur.is_unsafe(a)) == [True, True, True, True, True, False, True, False]
