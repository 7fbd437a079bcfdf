"""String columns: trimming, line splitting and text cleaning.

All functions take and return Columns, so a whole cleaning chain stays one
projection inside the scan stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausedelta.functions.stages import let

# The characters that count as white space, and those that end a line.
SPACE_CHARS = "".join(map(chr, (
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)))
SPACE = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
INLINE_SPACE = (
    r"[\t\x1F\x20\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
)
# White space other than blanks and line feeds. The class in front is quick per character: single ones and one range.
OTHER_SPACE = rf"[\t\x0B\f\r\x1C\x1D\x1E\x1F\x{{85}}\x{{A0}}\x{{1680}}-\x{{3000}}](?<={SPACE})"
OTHER_INLINE = rf"[\t\x1F\x{{A0}}\x{{1680}}-\x{{3000}}](?<={INLINE_SPACE})"
# One class first, then the second half of a CR LF pair: a quick test per character.
LINE_BREAK = r"[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"

# Boilerplate lines removed from every text, in this order, each after what a text with it must hold (one of, in lower case).
BOILERPLATE = (
    (("page", "/", "-"), r"(?:Page\s+\d+\s+(?:of\s+\d+)?|\d+\s*/\s*\d+|\-\s*\d+\s*\-|\bPage\s+\d+\b)\s*$"),
    (("this document is ",), r"This document is (?:provided )?for informational purposes only.*$"),
    (("official copy ",), r"Official copy (?:is )?on file in the office of the (?:City|County|Town) Clerk.*$"),
    (("all rights reserved",), r"All rights reserved\..*$"),
    (("draft",), r"Draft\s*[-–—]\s*Subject to (?:Change|Approval|Correction).*$"),
    (("published pursuant to ",), r"Published pursuant to (?:state law|municipal code|local government act).*$"),
    (("for questions regarding this agenda please contact",), r"For questions regarding this agenda please contact.*$"),
    (("in accordance with the americans with disabilities act",), r"In accordance with the Americans with Disabilities Act.*$"),
    (("crown copyright",), r"Crown Copyright\s*\d{4}.*$"),
)

PAGE_BREAK = "\n\n--- PAGE BREAK ---\n\n"


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACE_CHARS))


def non_blank(text: Column) -> Column:
    """Null when the text is null or empty."""
    return F.nullif(text, F.lit(""))


def split_lines(text: Column) -> Column:
    """Lines of a text; every Unicode line end counts, a final one adds no line."""
    # A text that ends its last line has an empty part after it, and so has an empty one: then nothing is left.
    return let(F.split(text, LINE_BREAK, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts))


def normalize_unicode(text: Column) -> Column:
    # Plain replacements: each is one search for bytes, and most texts hold none of them.
    for old, new in ((chr(0xA0), " "), ("‘", "'"), ("’", "'"), ("“", '"'), ("”", '"'), ("—", " - "), ("–", " - ")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def dehyphenate(text: Column) -> Column:
    joined = lambda t: F.regexp_replace(t, r"(?U)(\b[A-Za-z]+)-\n([A-Za-z]+\b)", "$1$2")
    return let(text, lambda t: F.when(F.contains(t, F.lit("-\n")), joined(t)).otherwise(t))


def strip_boilerplate(text: Column) -> Column:
    """A pattern runs only on texts that hold a mark of it in any case, looked for as bytes.

    A pattern takes whole lines and joins none, so no mark appears in between.
    """
    def without(t: Column, low: Column, marks: tuple[str, ...], pattern: str) -> Column:
        java = pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")
        held = reduce(Column.__or__, (F.contains(low, F.lit(m)) for m in marks))
        return let(t, lambda x: F.when(held, F.regexp_replace(x, rf"(?imd)^{SPACE}*{java}", "")).otherwise(x))

    return let(text, lambda t: let(F.lower(t), lambda low: reduce(lambda x, b: without(x, low, *b), BOILERPLATE, t)))


def strip_phrases(text: Column, phrases: Column) -> Column:
    """Delete each phrase of the array, literally and ignoring case."""
    pattern = lambda p: F.concat(
        F.lit(r"(?iu)\Q"), F.replace(p, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")
    )
    removed = F.aggregate(phrases, text, lambda acc, p: F.regexp_replace(acc, pattern(p), F.lit("")))
    return F.coalesce(removed, text)


def collapse_blank_lines(text: Column) -> Column:
    has = lambda t, part: F.contains(t, F.lit(part))

    def trimmed(t: Column) -> Column:
        t = F.regexp_replace(t, LINE_BREAK, "\n")
        return F.regexp_replace(F.regexp_replace(t, rf"{INLINE_SPACE}++(?=\n)", ""), rf"\n{INLINE_SPACE}+", "\n")

    # Without other white space than blanks and line feeds, and none of them side by side, lines are trimmed.
    lines = let(text, lambda t: F.when(has(t, " \n") | has(t, "\n ") | F.rlike(t, F.lit(OTHER_SPACE)), trimmed(t)).otherwise(t))
    return strip(let(lines, lambda t: F.when(has(t, "\n\n\n"), F.regexp_replace(t, r"\n{3,}", "\n\n")).otherwise(t)))


def clean_text(text: Column, phrases: Column | None = None) -> Column:
    """Unicode, hyphenation, boilerplate, per-source phrases, blank lines."""
    text = strip_boilerplate(dehyphenate(normalize_unicode(text)))
    if phrases is not None:
        text = strip_phrases(text, phrases)
    return collapse_blank_lines(text)


def comparable_line(line: Column) -> Column:
    """Form in which running headers of different pages are equal."""
    folded = F.regexp_replace(F.lower(strip(line)), r"\p{Nd}+", "#")
    return F.regexp_replace(folded, rf"{SPACE}+", " ")


def comparable_lines(text: Column) -> Column:
    """comparable_line of every line; digits and case are folded in the whole text, which holds each line's neighbours apart."""
    folded = F.regexp_replace(F.lower(text), r"\p{Nd}+", "#")
    spaced = lambda line: F.regexp_replace(strip(line), rf"{SPACE}+", " ")

    def lines(t: Column) -> Column:
        odd = F.contains(t, F.lit("  ")) | F.rlike(t, F.lit(OTHER_INLINE))
        return F.when(odd, F.transform(split_lines(t), spaced)).otherwise(F.transform(split_lines(t), lambda v: F.trim(v)))

    return let(folded, lines)


def reduction_pct(raw_len: Column, clean_len: Column) -> Column:
    """Share of characters removed by cleaning, in percent with one decimal."""
    share = F.round((raw_len - clean_len).cast("decimal(18,0)") * 100 / raw_len.cast("decimal(18,0)"), 1)
    return F.when(raw_len > 0, share.cast("double")).otherwise(F.lit(0.0))
