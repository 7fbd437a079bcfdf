"""Link discovery: from fetched pages to candidate documents."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.html import IN_TAG, attribute, element_with, inner_text
from clausedelta.functions.stages import exploded, with_computed
from clausedelta.functions.text import non_blank
from clausedelta.functions.urls import (
    classify_document,
    is_allowed_host,
    is_statutory,
    with_resolved_url,
)

_ANCHOR = rf"(?is)<a\b{IN_TAG}>.*?</a\s*>"
# What holds markup that is no part of the page.
_UNSEEN = rf"(?is)<!--.*?-->|<(script|style|template|noscript)\b{IN_TAG}>.*?</\1\s*>"

# Per adapter the links taken when a source sets no selector,
# the title of a link without text, and the platform name in the metadata.
ADAPTER_SELECTORS = {
    "municode": "a[href*='/codes/'], a[href*='ordinance'], a[href*='.pdf'], a[href*='nodeId'], .toc-item a, .municode-doc-link",
    "civicplus": "a[href*='/AgendaCenter/ViewFile/'], a[href*='/DocumentCenter/View/'], a[href*='.pdf']",
    "basic": "a[href*='.pdf'], a[href*='notice'], a[href*='minutes']",
}
DEFAULT_TITLES = {
    "custom": "Municipal Document",
    "granicus": "Legistar Document",
    "municode": "Municode Statutory Item",
    "civicplus": "CivicPlus Document",
    "basic": "Notice Document",
}
PLATFORMS = {
    "custom": "custom_heuristic",
    "granicus": "granicus_legistar",
    "municode": "municode_ecode360",
    "civicplus": "civicplus",
}


def extract_links(pages: DataFrame, html: str = "html", scopes: tuple[str, ...] = ()) -> DataFrame:
    """One row per ``<a>`` element, in page order; other columns stay.

    ``scopes`` are those of the selectors that the links will be tested with (see ``scopes_of``): per scope a
    column holds which of the page's links lie in such an element.
    """
    pages = with_computed(pages, **{html: F.regexp_replace(html, _UNSEEN, "")})
    if scopes:
        pages = with_computed(pages, **{scope_column(s): scope_spans(F.col(html), s) for s in scopes})
    anchors = F.regexp_extract_all(F.col(html), F.lit(_ANCHOR), F.lit(0))
    df = exploded(with_computed(pages, _anchors=anchors), "_anchors", "pos", "anchor")
    tag = F.regexp_extract("anchor", rf"^<{IN_TAG}>", 0)
    return with_computed(
        df,
        href=attribute(tag, "href"),
        text=inner_text(F.col("anchor")),
        link_title=attribute(tag, "title"),
        link_id=attribute(tag, "id"),
        link_class=attribute(tag, "class"),
    )


_SIMPLE = re.compile(
    r"^(?P<tag>a)?(?:\.(?P<cls>[\w-]+))?(?:\[(?P<attr>href|id|class|title)(?P<op>\*|\^|\$)?=['\"](?P<value>[^'\"]*)['\"]\])?$"
)
_SCOPE = re.compile(r"^(?P<tag>[a-z][a-z0-9]*)?(?:\.(?P<cls>[\w-]+)|#(?P<id>[\w-]+))?$")
_ATTR_COLUMN = {"href": "href", "id": "link_id", "class": "link_class", "title": "link_title"}


# Elements that hold nothing and have no closing tag.
_VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def _split_selector(selector: str) -> list[tuple[str | None, re.Match]]:
    """Scope and last part of every selector of a list."""
    out = []
    for one in selector.split(","):
        *scopes, last = one.split()
        parts = _SIMPLE.match(last)
        if parts is None or not any(parts.groups()) or len(scopes) > 1:
            raise ValueError(f"unsupported selector: {one.strip()!r}")
        if scopes and _SCOPE.match(scopes[0]) is None:
            raise ValueError(f"unsupported selector scope: {scopes[0]!r}")
        out.append((scopes[0] if scopes else None, parts))
    return out


def scopes_of(selector: str | None) -> tuple[str, ...]:
    return tuple(dict.fromkeys(scope for scope, _ in _split_selector(selector) if scope)) if selector else ()


def scope_column(scope: str) -> str:
    return "_in_" + scope.replace(".", "_class_").replace("#", "_id_")


def scope_spans(html: Column, scope: str) -> Column:
    """Array of (first, end): the links of a page, counted from 0, that lie in elements of the scope.

    One walk over the page's tags in order: an element of the scope ends at its own closing tag, as elements
    of its name inside it are counted, or with the page. A link is one token, so tags inside it count for nothing.
    """
    parts = _SCOPE.match(scope)
    name = parts["tag"] or "[a-z][a-z0-9]*"
    token = rf"{_ANCHOR}|(?is)<(?:{name})\b{IN_TAG}>|</(?:{name})\s*>"
    tokens = F.regexp_extract_all(html, F.lit(token), F.lit(0))

    def step(at: Column, tag: Column) -> Column:
        word = F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))
        link = tag.rlike(rf"{_ANCHOR}$")
        closing = F.startswith(tag, F.lit("</"))
        opens = ~link & ~closing & ~word.isin(*_VOID)
        if parts["cls"]:
            marked = F.array_contains(F.split(attribute(F.regexp_extract(tag, rf"^<{IN_TAG}>", 0), "class"), r"\s+"), parts["cls"])
        elif parts["id"]:
            marked = attribute(F.regexp_extract(tag, rf"^<{IN_TAG}>", 0), "id") == parts["id"]
        else:
            marked = F.lit(True)
        begins = (at["depth"] == 0) & opens & marked
        within = (at["depth"] > 0) & (word == at["name"]) & ~link
        depth = F.when(begins, 1).when(within & opens, at["depth"] + 1).when(within & closing, at["depth"] - 1).otherwise(at["depth"])
        ends = within & closing & (at["depth"] == 1)
        span = F.struct(at["first"].alias("first"), at["n"].alias("end"))
        return F.struct(
            depth.cast("int").alias("depth"), F.when(begins, word).otherwise(at["name"]).alias("name"),
            (at["n"] + F.when(link, 1).otherwise(0)).cast("int").alias("n"),
            F.when(begins, at["n"]).otherwise(at["first"]).cast("int").alias("first"),
            F.when(ends, F.concat(at["spans"], F.array(span))).otherwise(at["spans"]).alias("spans"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("name"), F.lit(0).alias("n"), F.lit(0).alias("first"),
        F.array().cast("array<struct<first:int,end:int>>").alias("spans"),
    )
    last = lambda at: F.struct(at["first"].alias("first"), at["n"].alias("end"))
    return F.aggregate(
        tokens, start, step, lambda at: F.when(at["depth"] > 0, F.concat(at["spans"], F.array(last(at)))).otherwise(at["spans"])
    )


def selector_test(selector: str) -> Column:
    """Compile a CSS selector list to a test on the columns of extract_links.

    Supported, each with an optional leading scope: ``a``, ``.cls``,
    ``a[attr*='x']`` (also ``^=``, ``$=``, ``=``), joined by commas. Anything
    else raises when the plan is built. Attribute tests respect case. A link is
    in scope when its place lies in an element of the scope; ``extract_links``
    has to be told the scopes.
    """
    tests = []
    for scope, parts in _split_selector(selector):
        test = F.lit(True)
        if parts["cls"]:
            test = test & F.array_contains(F.split("link_class", r"\s+"), parts["cls"])
        if parts["attr"]:
            column, value = F.col(_ATTR_COLUMN[parts["attr"]]), F.lit(parts["value"])
            compare = {"*": F.contains, "^": F.startswith, "$": F.endswith, None: lambda c, v: c == v}[parts["op"]]
            test = test & compare(column, value)
        if scope:
            spans = F.col(scope_column(scope))
            test = test & F.exists(spans, lambda x: (F.col("pos") >= x["first"]) & (F.col("pos") < x["end"]))
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)


def navigable(href: Column, mailto: bool = True, page_top: bool = True) -> Column:
    """False for empty and script links, and as asked for mail and '#' links."""
    keep = (href != "") & ~F.startswith(href, F.lit("javascript:"))
    if mailto:
        keep = keep & ~F.startswith(href, F.lit("mailto:"))
    return keep & (href != "#") if page_top else keep


def link_title(text: Column, title: Column, adapter: str | Column = "custom") -> Column:
    if isinstance(adapter, str):
        default = F.lit(DEFAULT_TITLES[adapter])
    else:
        default = F.try_element_at(F.create_map(*[F.lit(x) for p in DEFAULT_TITLES.items() for x in p]), adapter)
    return F.coalesce(non_blank(text), non_blank(title), default)


def dedupe_links(links: DataFrame) -> DataFrame:
    """First occurrence per (source_id, url) in page order.

    An aggregate, so copies of a popular link shrink before the shuffle.
    """
    rest = [c for c in links.columns if c not in ("source_id", "url")]
    first = links.groupBy("source_id", "url").agg(F.min_by(F.struct(*rest), "pos").alias("r"))
    return first.select("source_id", "url", "r.*")


def discover(pages: DataFrame, adapter: str = "custom", selector: str | None = None) -> DataFrame:
    """Candidate documents of fetched pages, as one adapter sees them.

    ``pages``: source_id, base_url, html. Custom pages without a selector keep
    the links that pass the statutory heuristic, and lose blocked hosts.
    """
    chosen = selector or ADAPTER_SELECTORS.get(adapter)
    links = extract_links(pages, scopes=scopes_of(chosen))
    if chosen:
        links = links.where(selector_test(chosen))
    links = links.where(navigable(F.col("href"), mailto=adapter == "custom")).drop("html")
    label = F.coalesce(non_blank(F.col("text")), F.col("link_title"))
    if adapter == "custom" and not chosen:
        links = links.where(is_statutory(F.col("href"), label))
    links = with_resolved_url(links, F.col("base_url"), F.col("href"), "url")
    if adapter == "custom":
        links = links.where((F.col("url") != "") & is_allowed_host(F.col("url")))
    links = links.withColumn("title", link_title(F.col("text"), F.col("link_title"), adapter))
    found = links.select(
        "source_id", "url", "pos", "title",
        classify_document(F.col("title"), F.col("url")).alias("document_type"),
        F.lit(PLATFORMS.get(adapter)).alias("platform"),
    )
    return dedupe_links(found)


def meeting_table_links(pages: DataFrame) -> DataFrame:
    """Agenda and minutes links of meeting tables, titled by their table row.

    The grid table of the page if there is one, else the first table whose id
    contains 'grid', else the whole page.
    """
    html = F.col("html")
    grid = r"\bclass\s*=\s*[\"'](?:[^\"']*\s)?rgMasterTable[\"'\s]"
    by_id = r"\bid\s*=\s*[\"'][^\"']*(?-i:grid)"
    # Tables inside the grid are counted, so the grid ends at its own closing tag.
    area = F.coalesce(element_with(html, grid, "table"), element_with(html, by_id, "table"), html)
    # Table rows as blocks, and links that stand outside any row.
    blocks = F.regexp_extract_all(area, F.lit(r"(?is)<tr\b[^>]*>.*?</tr\s*>|<a\b[^>]*>.*?</a\s*>"), F.lit(0))
    df = with_computed(pages.select("source_id", "base_url", "html"), _blocks=blocks).drop("html")
    df = exploded(df, "_blocks", "block_no", "html")
    cells = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<td\b[^>]*>.*?</td\s*>"), F.lit(0)), inner_text)
    df = with_computed(df, _cells=cells)
    has_context = F.size("_cells") >= 2
    df = df.withColumn("meeting", F.when(has_context, F.get("_cells", F.lit(0))).otherwise("")).withColumn(
        "meeting_date", F.when(has_context, non_blank(F.get("_cells", F.lit(1))))
    )
    links = extract_links(df.drop("_cells")).drop("html")
    links = links.where(
        selector_test("a[href*='View.ashx'], a[href*='.pdf'], a[id*='hlAgenda'], a[id*='hlMinutes']")
        & navigable(F.col("href"), mailto=False, page_top=False)
    )
    links = with_resolved_url(links, F.col("base_url"), F.col("href"), "url")
    label = link_title(F.col("text"), F.col("link_title"), "granicus")
    title = F.when(F.col("meeting") != "", F.concat("meeting", F.lit(" - "), label)).otherwise(label)
    links = links.withColumn("title", title)
    return dedupe_links(
        links.select(
            "source_id", "url", (F.col("block_no") * 1_000_000 + F.col("pos")).cast("bigint").alias("pos"), "title",
            classify_document(F.col("title"), F.col("url")).alias("document_type"),
            F.col("meeting_date").alias("published_date"), F.lit("granicus_legistar").alias("platform"),
        )
    )


def static_else_rendered(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Links of the static page; those of the rendered page where it gave none."""
    covered = static.select("source_id").distinct()
    return static.unionByName(rendered.join(covered, "source_id", "left_anti"))


def link_metadata(**entries: Column) -> Column:
    """Provenance of a link as a map without the missing entries."""
    pairs = [x for name, value in entries.items() for x in (F.lit(name), value.cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
