from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clausedelta.sources.listings import _filled_template as listings_filled
from clausedelta.sources.listings import template_pieces as listings_pieces
from clausedelta.functions.html import element, unescape, with_html_text
from clausedelta.operators import links as lk
from clausedelta.operators import pages as pg
from clausedelta.sources.feeds import feed_documents, feed_results
from clausedelta.sources.listings import listing_documents, listing_results

PAGE = """<html><body><nav><a href="/home">Home</a></nav>
<div class="toc-item big"><a class='x' href="/codes/1" title="T &amp; U"></a></div>
<A HREF='Notice.pdf' id=n1>Public <b>notice</b> </A> <a href="mailto:a@b.gov">notice mail</a> <a>no href</a>
<a href="#">top</a><a href="javascript:go()">view</a><a href="https://x.com/notice">notice</a><a href="Notice.pdf">again</a>
<a href="/about">Contact us</a><a href="/weather">Weather</a></body></html>"""


def pages(spark, *htmls):
    return spark.createDataFrame([(f"s{i}", "https://town.gov/d/", h) for i, h in enumerate(htmls)], "source_id string, base_url string, html string")


def test_extract_links(spark):
    rows = lk.extract_links(pages(spark, PAGE)).orderBy("pos").collect()
    assert [r.href for r in rows] == ["/home", "/codes/1", "Notice.pdf", "mailto:a@b.gov", "", "#", "javascript:go()", "https://x.com/notice", "Notice.pdf", "/about", "/weather"]
    assert (rows[1].link_title, rows[1].link_class) == ("T & U", "x")
    assert (rows[2].text, rows[2].link_id) == ("Publicnotice", "n1")


def test_links_of_valid_but_tricky_markup(spark):
    html = """<!-- <a href="/old.pdf">old</a> --><script>var s = '<a href="/js.pdf">js</a>';</script>
      <a title="a > b" href="/one.pdf">One &gt; two</a><a href='/q.pdf' title='it"s > that'>q</a>"""
    rows = lk.extract_links(pages(spark, html)).orderBy("pos").collect()
    assert [(r.href, r.text, r.link_title) for r in rows] == [("/one.pdf", "One > two", "a > b"), ("/q.pdf", "q", 'it"s > that')]


def test_character_references(spark):
    cases = {
        "&#9999999;": "\ufffd", "&#x110000;x": "\ufffdx", "&#xD800;": "\ufffd", "&#0;": "\ufffd", "&#146;": "\u2019", "&#x41;": "A",
        "&#65 b": "A b", "&comma;&lsqb;": ",[", "a&nbsp b": "a\xa0 b", "&amp;lt;": "&lt;", "AT&T &unknown; &": "AT&T &unknown; &",
        "&#99999999999999999999;": "\ufffd", "&#00000000065;": "A", "&notit;": "\xacit;", "plain": "plain",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.u for r in df.select("t", unescape(F.col("t")).alias("u")).collect()} == cases


def test_nested_containers(spark):
    html = [
        "<body><article>A<article>B</article>C</article>D</body>", '<main title="x > y">one<div>two</div></main>three',
        '<body><div id="content">a<div>b</div>c</div>d</body>', "<p>no container</p>", "<main>never closed <b>x</b>",
    ]
    df = spark.createDataFrame(list(enumerate(html)), "i int, html string")
    got = {r.i: r.t for r in with_html_text(df, "html", "t").collect()}
    assert got == {0: "A\nB\nC", 1: "one\ntwo", 2: "a\nb\nc", 3: "no container", 4: "never closed\nx"}


def test_feed_text_in_cdata(spark):
    body = "<rss><channel><item><title><![CDATA[Rules <b>A</b> & 3 < 4]]></title><link><![CDATA[https://t.gov/a?x=1&y=2]]></link></item></channel></rss>"
    df = spark.createDataFrame([("s", "https://t.gov/f", body)], "source_id string, endpoint_url string, body string")
    df = df.selectExpr("*", *(f"cast(null as string) {c}" for c in ("item_tag", "title_tag", "link_tag", "date_tag")))
    (row,) = feed_documents(df).collect()
    assert row.title == "Rules <b>A</b> & 3 < 4" and row.url.startswith("https://t.gov/a?")


def test_discover_generic(spark):
    rows = lk.discover(pages(spark, PAGE)).orderBy("pos").collect()
    assert [(r.title, r.url) for r in rows] == [
        ("T & U", "https://town.gov/codes/1"), ("Publicnotice", "https://town.gov/d/Notice.pdf"), ("Contact us", "https://town.gov/about"),
    ]


def test_selectors(spark):
    found = lk.extract_links(pages(spark, PAGE), scopes=(".toc-item",))
    pick = lambda s: [r.href for r in found.where(lk.selector_test(s)).orderBy("pos").collect()]
    assert pick("a[href*='.pdf'], .toc-item a") == ["/codes/1", "Notice.pdf", "Notice.pdf"]
    assert pick("a[id*='n1']") == ["Notice.pdf"]
    assert pick("a[href*='notice']") == ["https://x.com/notice"]
    assert lk.discover(pages(spark, PAGE), "municode").count() == 2
    for bad in ("div > a", "a:hover", "a b c d", "img[src*='x']"):
        with pytest.raises(ValueError):
            lk.selector_test(bad)


def test_meeting_table(spark):
    table = (
        '<a href="x.pdf">Outside</a><table class="a rgMasterTable"><tr><td>Council</td><td>1/2/2024</td><td><a href="View.ashx?M=A&amp;ID=1">Agenda</a>'
        '<a href="javascript:x" id="hlMinutes">m</a></td></tr><tr><td>Alone <a id="a_hlAgenda2" href="/ag/2"></a></td></tr></table>'
    )
    rows = lk.meeting_table_links(pages(spark, table, '<a href="x.pdf">Outside</a>')).orderBy("source_id", "pos").collect()
    assert [(r.title, r.url, r.published_date) for r in rows] == [
        ("Council - Agenda", "https://town.gov/d/View.ashx?M=A&ID=1", "1/2/2024"),
        ("Legistar Document", "https://town.gov/ag/2", None),
        ("Outside", "https://town.gov/d/x.pdf", None),
    ]


def test_meeting_grid_with_a_table_inside(spark):
    html = """<table class="rgMasterTable"><thead><tr><td><table><tr><td>head</td></tr></table></td></tr></thead>
      <tr><td>Council</td><td>2024-01-02</td><td><a href="/a.pdf">Agenda</a></td></tr></table><a href="/outside.pdf">no</a>"""
    rows = lk.meeting_table_links(pages(spark, html)).collect()
    assert [(r.url, r.title) for r in rows] == [("https://town.gov/a.pdf", "Council - Agenda")]


def test_dedupe_and_fallback(spark):
    df = spark.createDataFrame([("s", "u", 3, "c"), ("s", "u", 1, "a"), ("t", "u", 2, "b")], "source_id string, url string, pos int, title string")
    assert {(r.source_id, r.pos, r.title) for r in lk.dedupe_links(df).collect()} == {("s", 1, "a"), ("t", 2, "b")}
    static, rendered = df.where("source_id = 's'"), df.withColumn("title", F.lit("r"))
    assert sorted((r.source_id, r.title) for r in lk.static_else_rendered(static, rendered).collect()) == [("s", "a"), ("s", "c"), ("t", "r")]


def test_html_text(spark):
    main = "<html><head><title>T</title><style>x</style></head><body><header>H</header><main><p>One <i>two</i>&nbsp;&sect;&#167;&#x2014;&bogus; </p><script>var a='</p>';</script> <p> </p>Three</main><footer>F</footer></body></html>"
    nested = '<body>zero<div id="content">a<div>b<div>c</div></div>d</div>after</body>'
    cls = "<div class='big content'><p>in</p></div><div>out</div>"
    df = pages(spark, main, nested, cls, "<p>bare<!-- no --></p><p>two", "")
    out = [r.t for r in with_html_text(df, "html", "t").orderBy("source_id").collect()]
    assert out == ["One\ntwo\n§§—&bogus;\nThree", "a\nb\nc\nd", "in", "bare\ntwo", ""]


def test_containers_are_looked_for_once(spark):
    assert str(element(F.col("html"), "main")).count("<(main)") == 2  # its name and its content; not for every piece
    df = pages(spark, "<main>" + "<p>&amp;lt; &lt;b&gt; &amplt; &nbsp;&quot;x&quot</p>" * 3 + "<main>in</main>out</main>after")
    assert with_html_text(df, "html", "t").first().t == "\n".join(['&lt; <b> &lt; \u00a0"x"'] * 3 + ["in", "out"])


def paged(spark, docs):
    rows = [(d, i + 1, t, 0) for d, ps in docs.items() for i, t in enumerate(ps)]
    return spark.createDataFrame(rows, "document_id string, page_no int, page_text string, image_count int")


def test_running_headers(spark):
    docs = {
        "a": [f"Town Board - Page {i}\nSection {i}\nText number {'xyz'[i]} here\nAll rights reserved. T" for i in range(3)],
        "one": ["Same header\nbody\nSame header"],
        "four": ["Half header\na1 one", "Half header\nb2 two", "c3 three", "d4 four"],
    }
    out = {r.document_id: r.cleaned_text for r in pg.clean_multipage(paged(spark, docs)).collect()}
    assert out["a"] == "Text number x here\n\nText number y here\n\nText number z here"
    assert out["one"] == "Same header\nbody\nSame header"
    # Four pages need two occurrences only.
    assert out["four"] == "a1 one\n\nb2 two\n\nc3 three\n\nd4 four"


def test_low_density(spark):
    df = spark.createDataFrame([("a", 1, "short", 1), ("a", 2, "short", 0), ("a", 3, "  ", 0), ("b", 1, "x" * 40, 5)], "document_id string, page_no int, page_text string, image_count int")
    assert [r.needs_ocr for r in pg.low_density(df).orderBy("document_id", "page_no").collect()] == [True, False, True, False]
    assert {r.document_id: r.needs_ocr for r in pg.ocr_documents(df).collect()} == {"a": True, "b": False}


def listing(spark, *rows):
    cols = "source_id string, endpoint_url string, body string, items_key string, title_field string, url_field string, url_template string, content_field string, date_field string"
    return spark.createDataFrame([(str(i), "https://api.gov/v1", *(list(r) + [None] * 7)[:7]) for i, r in enumerate(rows)], cols)


def test_json_listings(spark):
    df = listing(
        spark,
        ('{"value":[{"id":7,"name":"Rule A","when":"2024"},{"name":"No id","url":"/u?utm_term=1","description":"d"},"text"]}', "value", "name", None, "https://r.gov/{id}/{when}", None, "when"),
        ('[{"title":"","filename":"f.pdf","link":"f.pdf","summary":5,"active":true}]',),
        ('{"title":false,"download_url":"/d"}',),
        ("{broken",), ("[]",), ('{"other":1}', "value"), ('{"value":null}', "value"), ('"scalar"',),
    )
    rows = listing_documents(df).orderBy("source_id", "pos").collect()
    assert [(r.source_id, r.title, r.url, r.snippet, r.date) for r in rows] == [
        ("0", "Rule A", "https://r.gov/7/2024", "", "2024"), ("0", "No id", "https://api.gov/u", "d", ""),
        ("1", "f.pdf", "https://api.gov/f.pdf", "5", ""), ("2", "Municipal Record", "https://api.gov/d", "", ""),
    ]
    ok = {r.source_id: (r.success, r.items_found) for r in listing_results(df).collect()}
    assert ok == {"0": (True, 2), "1": (True, 1), "2": (True, 1), "3": (False, 0), "4": (True, 0), "5": (True, 0), "6": (False, 0), "7": (True, 0)}


def test_feeds(spark):
    bodies = [
        '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A &amp; B</title><updated>d1</updated><link href="/1#x"/></entry><entry><title>Same</title><link href="/1"/></entry><entry><title>None</title></entry></feed>',
        "<rss><channel><item><title><![CDATA[Agenda]]></title><link> https://f.gov/2 </link></item></channel></rss>",
        '<a:feed xmlns:a="urn:x"><a:entry><a:link url="3.xml"/></a:entry></a:feed>',
        '<toc><Act href="a.xml"/><document href="b.xml"/></toc>',
        "<feed></feed>", "<html><body>error</body></html>", "<feed><entry>", "not xml",
    ]
    df = spark.createDataFrame(
        [(str(i), "https://f.gov/in/", b, None, None, None, "updated") for i, b in enumerate(bodies)],
        "source_id string, endpoint_url string, body string, item_tag string, title_tag string, link_tag string, date_tag string",
    )
    rows = feed_documents(df).orderBy("source_id", "pos").collect()
    assert [(r.source_id, r.title, r.url, r.date) for r in rows] == [
        ("0", "A & B", "https://f.gov/1", "d1"), ("1", "Agenda", "https://f.gov/2", None),
        ("2", "Statutory Record", "https://f.gov/in/3.xml", None), ("3", "Statutory Record", "https://f.gov/in/a.xml", None),
    ]
    assert [r.success for r in feed_results(df).orderBy("source_id").collect()] == [True] * 5 + [False] * 3


def test_template_formats(spark):
    """Every pair of value and format against Python's own formatting; what raises there fits nowhere here."""
    import json

    from clausedelta.sources import listings

    values = [0, 7, -42, 1234567, 2.5, -0.75, 0.125, 12345.678, "ab", "", "ünï", True, False]
    specs = ["", "d", "5", "05", "05d", "+d", " d", "<6", ">6", "^7", "*^9", "=8", "0>4", ",", "_", ",d", ".2f", "08.3f", "+.1f", ".0f", ",.2f", "%", ".1%", "x", "X", "04x", "o", "b", "s", ".1", "6.1", "-<5", "5q", ".2d"]
    rows, want = [], []
    for v in values:
        for f in specs:
            try:
                text = format(v, f)
            except ValueError:
                text = None
            if isinstance(v, float) and f in (".1", "6.1"):
                continue  # significant digits are not supported
            rows.append((len(rows), json.dumps({"v": v}), f))
            want.append(text)
    df = spark.createDataFrame(rows, "i int, body string, spec string").withColumn("m", F.from_json("body", "map<string,variant>"))
    got = {r.i: r.t for r in df.select("i", listings.formatted(F.col("m")["v"], F.col("spec"), F.lit(False)).alias("t")).collect()}
    odd = [(*rows[i][1:], got[i], want[i]) for i in range(len(rows)) if got[i] != want[i]]
    assert not odd, odd


def test_templates(spark):
    record = '[{"id": 7, "name": "Ann", "n": 1234.5, "nested": {"a": "x"}, "none": null, "flag": true}]'
    cases = {
        "https://t.gov/{id:03d}/{name:>5}": "https://t.gov/007/  Ann", "{{{id}}}": "{7}", "{nested[a]}-{flag}-{none}": "x-True-None",
        "{name!s:.2}|{n:,.1f}|{id!r:>3}": "An|1,234.5|  7", "{gone}": None, "{nested[b]}": None, "plain": "plain",
    }
    rows = [(i, t) for i, t in enumerate([*cases, "{id", "id}", "{name:d}", "{none:5}", "{}"])]
    df = spark.createDataFrame(rows, "i int, t string").withColumn("v", F.from_json(F.lit(record), "array<map<string,variant>>")[0])
    got = {r.t: (r.text, r.wrong) for r in df.select(
        "t", listings_filled(F.col("t"), F.col("v")).alias("text"),
        F.exists(listings_pieces(F.col("t"), F.col("v")), lambda p: p["wrong"]).alias("wrong"),
    ).collect()}
    assert {t: got[t][0] for t in cases} == cases and not any(got[t][1] for t in cases)
    assert all(got[t] == (None, True) for t in ("{id", "id}", "{name:d}", "{none:5}"))


def test_scope_is_a_place(spark):
    """The same link in the scope and outside it, scopes in scopes, void and unclosed elements."""
    same = '<a href="/x">X</a>'
    html = (
        f'{same}<nav class="top main">{same}<nav>{same}</nav><div>{same}</div></nav>{same}<div id="box"><div>{same}</div>{same}</div>'
        f'<img class="pic">{same}<p class="pic">{same}</p><!-- <nav>{same} -->{same}<nav>{same}'
    )
    wanted = {
        "nav a": [1, 2, 3, 10], ".main a": [1, 2, 3], "#box a": [5, 6], ".pic a": [8], "div a": [3, 5, 6], "nav.top a[href^='/']": [1, 2, 3],
        "nav.gone a": [], "nav a, .pic a": [1, 2, 3, 8, 10],
    }
    for selector, places in wanted.items():
        found = lk.extract_links(pages(spark, html), scopes=lk.scopes_of(selector)).where(lk.selector_test(selector))
        assert sorted(r.pos for r in found.select("pos").collect()) == places, selector
    twice = '<a href="a.pdf">Body</a><nav class="m"><a href="a.pdf">Menu</a></nav>'
    assert [(r.pos, r.title) for r in lk.discover(pages(spark, twice), selector=".m a").collect()] == [(1, "Menu")]
