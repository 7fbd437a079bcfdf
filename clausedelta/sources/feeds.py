"""Document links from Atom, RSS and plain XML indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.html import attribute, inner_text
from clausedelta.functions.stages import exploded, with_computed
from clausedelta.functions.text import non_blank, strip
from clausedelta.functions.urls import classify_document, is_allowed_host, with_resolved_url

# Elements that hold one record, in order of priority.
ITEM_TAGS = ("entry", "item", "Act", "Regulation", "document", "record")

_PREFIX = r"(?:[A-Za-z_][\w.\-]*:)?"


def _items(body: Column, tag: Column) -> Column:
    """All elements of that name, with or without a namespace prefix."""
    name = F.concat(F.lit(_PREFIX + r"\Q"), tag, F.lit(r"\E"))
    pattern = F.concat(
        F.lit("(?s)<"), name, F.lit(r"(?:\s[^>]*)?/>|<"), name, F.lit(r"(?:\s[^>]*)?>.*?</"), name, F.lit(r"\s*>")
    )
    return F.regexp_extract_all(body, pattern, F.lit(0))


def _first_element(item: Column, tag: Column) -> Column:
    """First descendant element of that name, '' when there is none."""
    inside = F.regexp_replace(item, r"^<[^>]*>", "")
    return F.coalesce(F.get(_items(inside, tag), F.lit(0)), F.lit(""))


def _opening(element: Column) -> Column:
    return F.regexp_extract(element, r"^<[^>]*>", 0)


def escaped_cdata(xml: Column) -> Column:
    """CDATA sections as escaped text."""
    def one(part: Column, i: Column) -> Column:
        text = F.substring_index(part, "]]>", 1)
        for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            text = F.replace(text, F.lit(char), F.lit(name))
        closed = (i > 0) & F.contains(part, F.lit("]]>"))
        return F.when(closed, F.concat(text, F.substr(part, F.instr(part, "]]>") + 3))).otherwise(part)

    joined = F.array_join(F.transform(F.split(xml, r"<!\[CDATA\[", -1), one), "")
    return F.when(F.contains(xml, F.lit("<![CDATA[")), joined).otherwise(xml)


def parse_feeds(payloads: DataFrame) -> DataFrame:
    """One row per payload with its record elements or the reason it failed.

    ``payloads``: source_id, endpoint_url, body and the optional settings
    item_tag, title_tag, link_tag, date_tag.
    """
    xml = escaped_cdata(F.regexp_replace("body", r"(?s)<!--.*?-->", ""))
    checked = F.from_xml(
        F.col("body"), "_any string, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    root = F.regexp_extract("_xml", rf"(?s)^[\s\x{{FEFF}}]*(?:<[?!][^>]*>\s*)*<{_PREFIX}([A-Za-z_][\w.\-]*)", 1)
    df = with_computed(payloads, _xml=xml, _checked=checked)
    df = with_computed(df, _root=root)
    error = (
        F.when((F.col("_root") == "") | F.col("_checked._bad").isNotNull() | F.col("_checked").isNull(),
               F.concat(F.lit("Expected XML from "), F.col("endpoint_url"), F.lit(" but could not parse it")))
        .when(F.lower("_root") == "html",
              F.concat(F.lit("Expected XML from "), F.col("endpoint_url"), F.lit(" but got HTML document")))
    )
    choices = F.when(F.col("item_tag").isNotNull(), _items(F.col("_xml"), F.col("item_tag")))
    for tag in ITEM_TAGS:
        present = F.col("_xml").rlike(rf"<{_PREFIX}{tag}[\s/>]")
        choices = choices.when(present, _items(F.col("_xml"), F.lit(tag)))
    items = choices.otherwise(F.array().cast("array<string>"))
    df = with_computed(df, error=error)
    return with_computed(df, items=F.when(F.col("error").isNull(), items)).drop("_xml", "_checked", "_root")


def feed_results(payloads: DataFrame) -> DataFrame:
    return parse_feeds(payloads).select(
        "source_id",
        F.col("error").isNull().alias("success"),
        F.when(F.col("error").isNull(), F.size("items")).otherwise(0).alias("items_found"),
        "error",
    )


def feed_documents(payloads: DataFrame) -> DataFrame:
    """Document links of all feeds that parse: one row per source and url."""
    df = parse_feeds(payloads).where("error is null")
    df = exploded(df.drop("body"), "items", "pos", "item")
    field = lambda name, default: F.coalesce(F.col(name), F.lit(default))
    df = with_computed(df, _link=_first_element(F.col("item"), field("link_tag", "link")))
    opening, record = _opening(F.col("_link")), _opening(F.col("item"))
    raw = F.coalesce(
        *[non_blank(attribute(opening, a)) for a in ("href", "url")],
        non_blank(inner_text(F.col("_link"))),
        *[non_blank(attribute(record, a)) for a in ("href", "url", "link")],
    )
    title = F.coalesce(non_blank(inner_text(_first_element(F.col("item"), field("title_tag", "title")))), F.lit("Statutory Record"))
    date = F.when(F.col("date_tag").isNotNull(), non_blank(inner_text(_first_element(F.col("item"), F.col("date_tag")))))
    df = with_computed(df, _raw=raw, title=title, date=date).select(
        "source_id", "endpoint_url", "pos", "_raw", "title", "date"
    ).where("_raw is not null")
    df = with_resolved_url(df, F.col("endpoint_url"), F.col("_raw"), "url").where(F.col("url") != "")
    kept = df.where(is_allowed_host(F.col("url"))).select(
        "source_id", "pos", strip(F.col("title")).alias("title"), "url",
        classify_document(F.col("title"), F.col("url")).alias("document_type"), "date",
        F.lit("xml_feed").alias("source_format"),
    )
    first = kept.groupBy("source_id", "url").agg(
        F.min_by(F.struct("pos", "title", "document_type", "date", "source_format"), "pos").alias("r")
    )
    return first.select("source_id", "url", "r.*")
