"""HTML columns by regular expression.

Works on well-formed tags and does not repair broken markup. Comments and
scripts go first, quoted attribute values may hold ``>``, and a container ends
at its own closing tag: elements of its name inside it are counted.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.functions.stages import let, with_computed
from clausedelta.functions.text import strip

# Elements that hold no content.
NON_CONTENT_TAGS = ("script", "style", "nav", "footer", "header", "noscript", "svg", "form", "aside", "iframe")


# The inside of a tag up to its end; a quoted value may hold ">". Possessive, so that it never backtracks.
IN_TAG = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
# What a browser reads for the numbers 128 to 159: the Windows code page, where it has a character.
C1_TEXT = "".join(bytes([i]).decode("cp1252", "replace") for i in range(128, 160))
# Names that the standard also allows without their semicolon.
COMMON_NAMES = ("amp;", "lt;", "gt;", "quot;", "nbsp;")
BARE_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))


def _entity_map() -> Column:
    """Names and characters as two split literals, folded to one map constant."""
    pairs = [(n.rstrip(";"), c) for n, c in html5.items() if n.endswith(";")]
    return F.map_from_arrays(
        F.split(F.lit(" ".join(n for n, _ in pairs)), " "),
        F.split(F.lit("\x01".join(c for _, c in pairs)), "\x01"),
    )


def _numbered(part: Column) -> Column:
    """Character of a numeric reference at the start of the text, null without one.

    Numbers that are no character (0, surrogates, beyond the last code point)
    give the replacement character.
    """
    digits = F.regexp_extract(part, r"^#([xX][0-9A-Fa-f]+|[0-9]+);?", 1)
    plain = F.regexp_replace(digits, r"^[xX]?0*", "")
    hexed = F.startswith(F.lower(digits), F.lit("x"))
    size = F.length(plain)
    code = F.when(hexed & (size <= 6), F.conv(plain, 16, 10)).when(~hexed & (size <= 7), F.conv(plain, 10, 10)).cast("int")
    good = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    safe = F.when(good, code).otherwise(0xFFFD)
    char = F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")
    return (
        F.when(digits == "", F.lit(None))
        .when(code.between(128, 159), F.substr(F.lit(C1_TEXT), code - 127, F.lit(1)))
        .otherwise(char)
    )


def unescape(text: Column) -> Column:
    """Replace named and numeric character references in one pass."""
    table = _entity_map()

    def one(part: Column, i: Column) -> Column:
        closed = F.try_element_at(table, F.regexp_extract(part, r"^([A-Za-z][A-Za-z0-9]*);", 1))
        bare = F.regexp_extract(part, rf"^({BARE_NAMES})", 1)
        number = _numbered(part)
        found = F.when(i == 0, part)
        # The table is searched from its start, so frequent names come before it.
        for name in COMMON_NAMES:
            found = found.when(F.startswith(part, F.lit(name)), F.concat(F.lit(html5[name]), F.substr(part, F.lit(len(name) + 1))))
        return (
            found.when(closed.isNotNull(), F.concat(closed, F.regexp_replace(part, r"^[A-Za-z0-9]+;", "")))
            .when(number.isNotNull(), F.concat(number, F.regexp_replace(part, r"^#(?:[xX][0-9A-Fa-f]+|[0-9]+);?", "")))
            .when(bare != "", F.concat(F.try_element_at(table, bare), F.substr(part, F.length(bare) + 1)))
            .otherwise(F.concat(F.lit("&"), part))
        )

    decoded = F.array_join(F.transform(F.split(text, "&", -1), one), "")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def drop_elements(html: Column, tags=NON_CONTENT_TAGS) -> Column:
    html = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    names = "|".join(tags)
    # Content up to the closing tag of the same name; a back reference pairs them.
    html = F.regexp_replace(html, rf"(?is)<({names})\b{IN_TAG}(?<!/)>.*?</\1\s*>", "")
    return F.regexp_replace(html, rf"(?is)<(?:{names})\b{IN_TAG}(?<=/)>", "")


def element(html: Column, tag: str) -> Column:
    """Inner HTML of the first such element, null when there is none."""
    return element_with(html, "", tag)


def element_with(html: Column, attribute_pattern: str, name: str = "[A-Za-z][A-Za-z0-9]*") -> Column:
    """Inner HTML of the first element whose opening tag matches, to the end if it is never closed.

    Same-name elements inside it are counted, so the right closing tag ends it.
    """
    within = rf"(?=[^>]*?{attribute_pattern})" if attribute_pattern else ""
    opening = rf"<({name})\b{within}{IN_TAG}>"

    def inner(tag: Column, pieces: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            name = F.lower(F.regexp_extract(piece, r"^(/?[A-Za-z][A-Za-z0-9]*)", 1))
            depth = acc["depth"] + F.when(name == tag, 1).when(name == F.concat(F.lit("/"), tag), -1).otherwise(0)
            return F.struct(
                F.when(acc["depth"] == 0, 0).otherwise(depth).cast("int").alias("depth"),
                (acc["n"] + F.when((acc["depth"] == 0) | (depth == 0), 0).otherwise(1)).cast("int").alias("n"),
            )

        walked = F.aggregate(
            F.slice(pieces, 2, F.greatest(F.size(pieces), F.lit(1))),
            F.struct(F.lit(1).alias("depth"), F.lit(1).alias("n")),
            step,
        )
        return F.array_join(F.slice(pieces, 1, walked["n"]), "<")

    # The tag and what follows it are looked for once, not again for every piece.
    pieces = F.split(F.regexp_extract(html, rf"(?is){opening}(.*)$", 2), "<", -1)
    return let(
        F.lower(F.regexp_extract(html, rf"(?is){opening}", 1)), lambda tag: F.when(tag != "", let(pieces, lambda p: inner(tag, p)))
    )


def select_first(html: Column, selector: str) -> Column:
    """Inner HTML for a simple selector: ``tag``, ``#id`` or ``.class``."""
    if selector.startswith("#"):
        return element_with(html, rf"\bid\s*=\s*[\"']?\Q{selector[1:]}\E(?=[\"'\s>])")
    if selector.startswith("."):
        return element_with(html, rf"\bclass\s*=\s*[\"'](?:[^\"']*\s)?\Q{selector[1:]}\E(?=[\"'\s])")
    if not selector.isalnum():
        raise ValueError(f"unsupported container selector: {selector!r}")
    return element(html, selector)


def text_nodes(html: Column) -> Column:
    """Trimmed non-blank text nodes in order."""
    nodes = F.transform(F.split(html, rf"<(?:[A-Za-z/!?]{IN_TAG}|[^>]*)>", -1), lambda t: strip(unescape(t)))
    return F.filter(nodes, lambda t: t != "")


def with_html_text(df: DataFrame, html: str, out: str, selector: str | None = None) -> DataFrame:
    """Add the text of a page: one line per text node of its content container.

    The container is the selector's element, else main, article, #content,
    .content, body, in this order.
    """
    df = with_computed(df, _content=drop_elements(F.col(html)))
    content = F.col("_content")
    names = ([selector] if selector else []) + ["main", "article", "#content", ".content", "body"]
    # Pages without any container lose their title and document type line.
    whole = F.regexp_replace(content, r"(?is)<!doctype[^>]*>|<title\b.*?</title>", "")
    df = with_computed(df, _container=F.coalesce(*[select_first(content, n) for n in names], whole))
    lines = F.array_join(text_nodes(F.col("_container")), "\n")
    return with_computed(df, **{out: lines}).drop("_content", "_container")


def inner_text(html: Column) -> Column:
    """Text of a fragment: each text node trimmed, then joined without a gap."""
    return F.array_join(text_nodes(html), "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of an opening tag, '' when it is absent."""
    pattern = rf"(?is)\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])
    return unescape(value)
